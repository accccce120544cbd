"""Registered queries: every operator over its stand-in tables, with the SQL that gives the same rows."""
