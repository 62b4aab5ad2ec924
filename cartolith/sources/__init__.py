"""Readers of map extracts, rule lists and catalogues."""
