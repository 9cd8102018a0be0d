"""Registered queries: operators bound to the driver tables, with the SQL they must equal."""
