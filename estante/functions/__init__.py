"""Column expressions: text, identifiers, citations, naming."""
