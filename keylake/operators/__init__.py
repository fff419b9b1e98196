"""keylake.operators"""
