"""Operators for large text-training corpora; nothing else in the package imports this subpackage."""
