"""Column expressions: text cleaning, reply parsing, messages, verdicts."""
