"""Partitions, rules and everything that is computed with them."""
