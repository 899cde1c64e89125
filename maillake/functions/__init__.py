"""Column expressions: headers, dates, text, flags, predicates, MIME."""
