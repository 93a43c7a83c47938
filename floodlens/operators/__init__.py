"""Relational operators: every one takes DataFrames and returns DataFrames."""
