"""Registered queries with the SQL that gives the same result, one module per operator family."""
