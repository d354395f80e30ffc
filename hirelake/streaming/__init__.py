"""Streaming on postings."""
