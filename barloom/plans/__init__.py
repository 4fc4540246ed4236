"""Registered queries: each binds an operator to the given tables and names the SQL it must equal."""
