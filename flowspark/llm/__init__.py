"""Operators for preparing training text, one module each; nothing else in the library imports them."""
