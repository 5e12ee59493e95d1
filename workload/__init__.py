"""The registered queries, their input views over the given tables, and their SQL twins."""
