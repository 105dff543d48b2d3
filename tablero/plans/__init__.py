"""Jobs of several steps, each ending in a written table."""
