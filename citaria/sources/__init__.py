"""citaria.sources"""
