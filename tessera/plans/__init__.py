"""Skew-safe primitives and the analytics built from the operators."""
