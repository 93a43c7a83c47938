"""Registered queries: each Spark plan next to the SQL that states its result."""
