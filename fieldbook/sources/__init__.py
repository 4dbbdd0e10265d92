"""fieldbook.sources"""
