"""Operators over pairs, nodes, graphs, sequences and scores."""
