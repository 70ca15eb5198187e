"""citaria.streaming"""
