"""Column expressions: text semantics, array statistics and document features."""
