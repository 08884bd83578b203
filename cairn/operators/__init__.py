"""Relational, statistical and clustering operators."""
