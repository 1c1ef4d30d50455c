"""hawthorn.plans"""
