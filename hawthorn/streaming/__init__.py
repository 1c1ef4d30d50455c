"""hawthorn.streaming"""
