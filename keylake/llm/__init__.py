"""Operators for training-data pipelines. Nothing else in keylake imports this subpackage."""
