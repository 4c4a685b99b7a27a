"""Relational operators: filters, roll-ups, search, neighbours, table changes."""
