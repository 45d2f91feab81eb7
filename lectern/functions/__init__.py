"""Column builders: text parsing, times, labels, filter predicates."""
