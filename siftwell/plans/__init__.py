"""Registered queries, by family, each with the SQL it is compared with."""
