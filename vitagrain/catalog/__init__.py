"""Registered queries and the SQL each one is checked against."""
