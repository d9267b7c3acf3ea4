"""Membership functions as SQL expressions."""
