"""citaria.operators"""
