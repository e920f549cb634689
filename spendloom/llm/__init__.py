"""Operators a training-data pipeline needs, on top of Spark; nothing else in the library imports them."""
