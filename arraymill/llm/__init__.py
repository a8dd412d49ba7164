"""Operators for large text-training corpora. Nothing else in the package imports this one."""
