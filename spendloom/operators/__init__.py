"""Relational operators over calls, tool calls and sessions."""
