"""Operators over the page index: each field is a Catalyst expression."""
