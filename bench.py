"""Benchmark: prints one JSON line with the seconds each headline query takes.

Each query runs twice in one session and the better run counts, so that the
figure is the work and not the compilation of its first plan.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendloom.plans import ingest  # noqa: E402
from spendloom.plans.catalog import QUERIES  # noqa: E402
from spendloom.plans.store import Store  # noqa: E402
from spendloom.session import local_session  # noqa: E402
from spendloom.sources import claude, registry  # noqa: E402
from spendloom.sources.prices import builtin_prices  # noqa: E402

HEADLINE = [
    # rollups over calls and tool calls
    "models", "daily_by_model", "project_models", "tools", "totals", "providers", "sessions_rollup",
    "tool_cost_asof", "activity_hourly", "activity_filled", "burn_windows", "filter_sessions_semi", "project_tree",
    # prices
    "tiered_cost", "resolve_price", "reprice",
    # logs to rows
    "ingest_pi", "ingest_claude", "ingest_codex", "ingest_gemini", "ingest_opencode", "ingest_agy",
    "complete_lines", "response_time", "counter_deltas",
    # keyed writes
    "upsert_calls", "upsert_tools", "classify_files",
]
RUNS = 2


def passes(spark, logs: int = 150, calls: int = 20) -> dict[str, float]:
    """Seconds of a first pass over some logs, of one that finds nothing new, and of one after a line more in one log."""
    home = Path(tempfile.mkdtemp(prefix="spark-"))
    (home / "logs").mkdir()

    def said(i: int) -> str:
        usage = {"input_tokens": 100 + i, "output_tokens": 5}
        message = {"id": f"m{i}", "model": "claude-sonnet-4", "content": [], "usage": usage}
        return json.dumps({"type": "assistant", "timestamp": f"2026-01-01T00:{i % 60:02d}:00Z", "cwd": "/w", "uuid": f"u{i}", "message": message}) + "\n"

    for n in range(logs):
        (home / "logs" / f"s{n}.jsonl").write_text("".join(said(i) for i in range(calls)))
    source = registry.LogSource("claude", (str(home / "logs"),), claude.normalise, needs=claude.needs)
    store, prices, out = Store(spark, str(home / "store")), builtin_prices(spark), {}
    for name in ("pass_first", "pass_idle", "pass_append"):
        if name == "pass_append":
            with open(home / "logs" / "s7.jsonl", "a") as f:
                f.write(said(calls))
        start = time.perf_counter()
        ingest.run_pass(spark, store, [source], prices, datetime(2026, 1, 2))
        out[name] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, app="bench")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    seconds.update(passes(spark))
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of best of two runs; pass_* are single runs beside it",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
