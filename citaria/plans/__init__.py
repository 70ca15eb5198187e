"""citaria.plans"""
