"""Sharded SQL analytics on PySpark."""
