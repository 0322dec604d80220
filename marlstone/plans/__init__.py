"""Registered queries over the driver tables, with SQL twins."""
