"""Training-data operators: one module per operator, ``queries`` registers the thin contract queries."""
