"""Readers that turn logs and price lists into rows."""
