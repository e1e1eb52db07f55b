"""Relational operators over phylogenetic frames."""
