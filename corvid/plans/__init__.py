"""Queries over the driver's tables, by theme; ``registry`` keeps them."""
