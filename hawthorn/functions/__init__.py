"""hawthorn.functions"""
