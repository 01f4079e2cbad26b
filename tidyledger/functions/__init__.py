"""Scalar rules as Catalyst column expressions."""
