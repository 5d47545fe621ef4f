"""Source code to triples."""
