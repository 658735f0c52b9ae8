"""Matchers compiled to predicates, and the registered queries."""
