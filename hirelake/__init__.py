"""Spark jobs over large job-posting corpora."""
