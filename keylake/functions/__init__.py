"""keylake.functions"""
