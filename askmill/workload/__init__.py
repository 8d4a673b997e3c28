"""Queries over the star-schema test tables, with SQL that gives the same rows."""
