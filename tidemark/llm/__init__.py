"""Operators for preparing training text at scale. Nothing else in tidemark imports this subpackage."""
