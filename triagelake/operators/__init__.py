"""triagelake.operators"""
