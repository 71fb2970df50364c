"""Helpers that shape physical plans: shared scratch tables and checked broadcasts."""
