"""Registered queries, and the projection of the test tables on the graph model."""
