"""Registered queries: each module pairs Spark plans with the SQL they must equal."""
