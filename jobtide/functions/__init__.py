"""Column expressions: id codec, line parsing, intervals, state and outcome classes."""
