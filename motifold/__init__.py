"""Temporal property-graph pattern matching on PySpark."""
