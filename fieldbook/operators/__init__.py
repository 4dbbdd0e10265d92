"""fieldbook.operators"""
