"""Column expressions: no actions, no Python workers."""
