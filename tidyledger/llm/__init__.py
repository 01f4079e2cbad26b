"""Preparation of training text from table cells: one module per operator, ``queries`` registers them."""
