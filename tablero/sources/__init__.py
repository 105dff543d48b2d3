"""Table sources and sinks of the sales model."""
