"""Column expressions: text, dates, money and vectors."""
