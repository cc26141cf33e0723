"""Operators for preparing large-scale training text.

Nothing else in the package imports this subpackage.
"""
