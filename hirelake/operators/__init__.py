"""Operators on postings."""
