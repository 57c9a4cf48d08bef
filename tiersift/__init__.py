"""Tiered message triage on Spark: every operator is a DataFrame -> DataFrame function."""
