"""Rules over tabular evidence of compute waste: sources, operators, functions, query plans and streams on Spark."""
