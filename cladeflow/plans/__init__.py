"""Queries of the tree engine on the provided tables."""
