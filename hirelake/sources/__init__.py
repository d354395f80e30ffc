"""Sources on postings."""
