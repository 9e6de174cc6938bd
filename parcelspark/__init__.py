"""Lease and property portfolio analytics on PySpark."""
