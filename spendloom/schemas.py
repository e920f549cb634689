"""Canonical schemas. Every source produces these and every operator reads them."""

from __future__ import annotations

# The six agents whose logs are read.
AGENTS = ["pi", "claude", "codex", "gemini", "agy", "opencode"]

TOKEN_COLUMNS = [
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_write_tokens",
    "reasoning_tokens",
    "total_tokens",
]

RAW_LINES = "path STRING, agent STRING, ordinal BIGINT, line STRING"

# One row per model request. `ts` is epoch seconds and 0 means unknown; `day` is
# '' then. `billable_output_tokens` is what the output rate applies to.
CALLS = """
    session_uid STRING, call_key STRING, agent STRING, project STRING, model STRING,
    ts BIGINT, day STRING,
    input_tokens BIGINT, output_tokens BIGINT, cache_read_tokens BIGINT,
    cache_write_tokens BIGINT, cache_write_1h_tokens BIGINT, reasoning_tokens BIGINT,
    total_tokens BIGINT, billable_output_tokens BIGINT,
    llm_seconds DOUBLE, cost_usd DECIMAL(24,12), priced BOOLEAN
"""

# One row per tool run.
TOOL_CALLS = """
    session_uid STRING, call_key STRING, agent STRING, project STRING, tool STRING,
    ts BIGINT, seconds DOUBLE, is_error BOOLEAN
"""

# Identity of a session: what the rows cannot tell.
IDENTITIES = """
    uid STRING, agent STRING, project STRING, path STRING, title STRING,
    seen_first_ts BIGINT, seen_last_ts BIGINT, orphaned BOOLEAN
"""

FILE_STATE = """
    path STRING, agent STRING, size BIGINT, mtime TIMESTAMP, consumed BIGINT,
    prefix_hash STRING, prefix_len BIGINT, cursor STRING, session_uid STRING,
    complete BOOLEAN, scanned_at TIMESTAMP, windows STRING
"""

SCAN_STATUS = """
    agent STRING, last_scan_at TIMESTAMP, last_full_at TIMESTAMP, files_seen BIGINT,
    files_changed BIGINT, calls_ingested BIGINT, error STRING
"""

# One row per log that the last pass which tried it could not read.
FAILURES = "path STRING, agent STRING, error STRING, failed_at TIMESTAMP"

# How far each landed table or conversation is read; ``ties`` tells which rows stand at that position.
CURSORS = "source STRING, agent STRING, position BIGINT, ties STRING"

# How often the steps of a conversation name a working directory.
VOTES = "conversation STRING, path STRING, votes BIGINT"

# Rates are dollars per million tokens. A tier replaces all four from a prompt
# size upward.
PRICES = """
    key STRING, source STRING,
    input DECIMAL(18,6), output DECIMAL(18,6), cache_read DECIMAL(18,6), cache_write DECIMAL(18,6),
    tiers ARRAY<STRUCT<min_prompt: BIGINT, input: DECIMAL(18,6), output: DECIMAL(18,6),
                       cache_read: DECIMAL(18,6), cache_write: DECIMAL(18,6)>>
"""

# One row per session, the sums of its calls and tool calls.
SESSIONS = """
    uid STRING, agent STRING, project STRING, path STRING, title STRING, orphaned BOOLEAN, first_ts BIGINT, last_ts BIGINT,
    calls BIGINT, input_tokens BIGINT, output_tokens BIGINT, cache_read_tokens BIGINT, cache_write_tokens BIGINT,
    reasoning_tokens BIGINT, total_tokens BIGINT, cost_usd DECIMAL(34,12), tool_calls BIGINT, tool_errors BIGINT,
    llm_seconds DOUBLE, tool_seconds DOUBLE, wall_seconds DOUBLE
"""
