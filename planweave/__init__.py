"""Declarative pipelines and analytics on PySpark."""
