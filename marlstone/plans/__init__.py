"""Queries over whole tables."""
