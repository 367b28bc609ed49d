"""Operators on tables of documents."""
