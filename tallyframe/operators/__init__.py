"""Joins, keyed aggregates and the reconciliation operator."""
