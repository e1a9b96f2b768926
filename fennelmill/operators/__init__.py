"""Relational operators: each takes DataFrames and returns one."""
