"""Registered queries: thin uses of the operators on the given tables, with SQL."""
