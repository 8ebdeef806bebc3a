"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; it can be removed without touching the rest.
"""
