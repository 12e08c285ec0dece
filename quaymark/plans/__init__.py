"""Composed plans: full evaluation, budgeted search, query catalogue."""
