"""Registered queries on the shared test tables, each next to its SQL twin."""
