"""triagelake.sources"""
