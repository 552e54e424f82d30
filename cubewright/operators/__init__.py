"""Operators that shape rows and filter contexts, and the data tools."""
