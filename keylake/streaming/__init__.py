"""keylake.streaming"""
