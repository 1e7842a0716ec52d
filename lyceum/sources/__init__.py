"""Readers, writers and the views that give the star-schema test tables their university roles."""
