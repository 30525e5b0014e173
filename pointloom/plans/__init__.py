"""Registered queries over the given tables, with the same queries in SQL where SQL can express them."""
