"""Registered queries over the given tables, the SQL they are held against, and the whole job for a sample."""
