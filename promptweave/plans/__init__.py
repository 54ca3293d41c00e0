"""Composed jobs: each reads tables, runs operators, writes tables."""
