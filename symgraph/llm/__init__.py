"""Operators for preparing large-scale training data.

Nothing outside this package imports it; the query registry adds its queries
only where it is present.
"""
