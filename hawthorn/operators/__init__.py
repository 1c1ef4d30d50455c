"""hawthorn.operators"""
