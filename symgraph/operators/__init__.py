"""Relational and graph operators over node, edge and symbol tables."""
