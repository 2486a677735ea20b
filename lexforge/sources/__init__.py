"""lexforge.sources"""
