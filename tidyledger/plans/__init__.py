"""Reusable plan shapes and the operational jobs built on them."""
