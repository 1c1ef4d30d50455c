"""hawthorn.sources"""
