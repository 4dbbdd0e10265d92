"""fieldbook.functions"""
