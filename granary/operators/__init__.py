"""Relational operators: inventory, pairs, graphs, splits, leak audit, detection metrics, sessions and checks."""
