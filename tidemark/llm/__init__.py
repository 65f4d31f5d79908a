"""Operators for preparing training text at corpus scale, one module each; ``registry`` has their queries and SQL."""
