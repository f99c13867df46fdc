"""Registered queries: a Spark plan and the SQL that must give the same rows."""
