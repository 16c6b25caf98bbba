"""Feeds derived from plain tables, and the registered queries with their SQL."""
