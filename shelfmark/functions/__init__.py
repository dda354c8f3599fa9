"""Column expressions: native Catalyst, no Python UDF."""
