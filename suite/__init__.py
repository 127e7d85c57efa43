"""Registered queries over the supplied tables, with the SQL they must agree with."""
