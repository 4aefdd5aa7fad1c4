"""Correctness checks: test inputs, registered queries and their SQL oracles."""
