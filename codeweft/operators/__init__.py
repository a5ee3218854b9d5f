"""Operators over the node and edge tables of a code graph."""
