"""Column expressions: time, identifiers, parsers, constraints and calendars."""
