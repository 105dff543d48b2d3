"""Column helpers: money, periods, seeded draws, distributed numbering."""
