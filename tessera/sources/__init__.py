"""Builders, generators, text readers and test-table derivations."""
