"""keylake.sources"""
