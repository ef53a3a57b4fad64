"""Column expressions: patterns, spans, masking, labels, text."""
