"""Operators on tables of image records."""
