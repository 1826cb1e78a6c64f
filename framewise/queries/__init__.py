"""Queries that bind operators to tables, each with the SQL that another engine can check it by."""
