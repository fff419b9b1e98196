"""Parsers of certificates and keys: small readers of bytes that Spark maps over partitions."""
