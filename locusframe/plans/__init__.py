"""Whole plans: the driver's queries with their SQL, and pipelines made of several operators."""
