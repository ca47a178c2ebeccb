"""Queries of the engine's own operators, and the SQL that checks them."""
