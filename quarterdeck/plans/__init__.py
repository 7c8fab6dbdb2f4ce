"""Whole flows: from stored source tables to company documents and briefs."""
