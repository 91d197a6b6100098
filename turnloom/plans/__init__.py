"""Whole plans: the offline scenario with its measures, prompts, and the catalogue of queries."""
