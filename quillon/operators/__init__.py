"""Operators on documents, their lines and their history."""
