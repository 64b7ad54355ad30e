"""Column expressions: row features, scores, routing, evidence."""
