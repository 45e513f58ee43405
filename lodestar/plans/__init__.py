"""Queries: each module registers its own when imported."""
