"""Column builders: report periods, returns and bins, statistics."""
