"""Operators for preparing training text, each by its own module; ``registry`` lists their queries."""
