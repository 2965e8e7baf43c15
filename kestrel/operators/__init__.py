"""Relational operators of the lookalike-domain engine."""
