"""Scalar functions, as Column expressions where the built-ins suffice and Arrow-batched UDFs elsewhere."""
