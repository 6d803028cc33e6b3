"""Cohort analytics on Spark: dirty fact tables around one entity table."""
