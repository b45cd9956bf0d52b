"""Column expressions: predicates and flags, integer/decimal arithmetic, text."""
