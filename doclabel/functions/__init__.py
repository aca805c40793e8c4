"""Column functions: text, subject codes and score arrays."""
