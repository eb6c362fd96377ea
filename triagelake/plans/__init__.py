"""triagelake.plans"""
