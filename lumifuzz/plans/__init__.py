"""Projections that rule bases compile to, and the registered queries."""
