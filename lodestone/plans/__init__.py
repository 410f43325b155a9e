"""Registered queries and the SQL that yields the same rows."""
