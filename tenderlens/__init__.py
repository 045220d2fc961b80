"""Procurement-risk analytics expressed as Spark DataFrame transformations."""
