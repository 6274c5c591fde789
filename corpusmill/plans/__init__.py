"""Whole queries: the catalogue, its SQL, and the two command-line jobs."""
