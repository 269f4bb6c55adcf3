"""Operators for preparing training text; see README.  Nothing outside this folder imports it."""
