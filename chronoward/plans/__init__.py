"""Queries that bind the operators to tables, each with its SQL twin."""
