"""Base views over the given tables, and the registered queries on them."""
