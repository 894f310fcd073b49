"""Column expressions: rates, names, types, canonical text, display formats."""
