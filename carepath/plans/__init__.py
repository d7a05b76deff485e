"""Composed plans: named stand-in inputs, the registered queries and their SQL oracle, reports, and the
whole-study workflow."""
