"""Whole-table plans: the full profile, report tables and the batch run."""
