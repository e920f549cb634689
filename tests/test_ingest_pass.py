"""The ingest pass over real files: append, rewrite, delete, partial lines, failures, idle."""

import json
import os
from datetime import datetime, timedelta

import pytest

from spendloom.operators import rollups
from spendloom.plans import ingest
from spendloom.plans.store import Store
from spendloom.session import cut_lineage
from spendloom.sources import claude, gemini, listing, pi, registry
from spendloom.sources import lines as lines_module
from spendloom.sources.lines import discover, read_files, read_lines
from spendloom.sources.prices import builtin_prices

NOW = datetime(2026, 1, 1)


def said(i, tokens=100, name="claude-sonnet-4", session="s"):
    return json.dumps({
        "type": "assistant", "timestamp": f"2026-01-01T00:{i:02d}:00Z", "cwd": "/work", "uuid": f"u{i}",
        "message": {"id": f"m{i}", "model": name, "content": [], "usage": {"input_tokens": tokens, "output_tokens": 5}},
    }) + "\n"


@pytest.fixture()
def world(spark, tmp_path):
    root = tmp_path / "home" / ".claude" / "projects" / "p"
    root.mkdir(parents=True)
    source = registry.LogSource("claude", (str(tmp_path / "home" / ".claude" / "projects"),), claude.normalise)
    store = Store(spark, str(tmp_path / "store"))
    prices = builtin_prices(spark)
    clock = [NOW]

    def run(sources=None):
        clock[0] += timedelta(minutes=1)
        return ingest.run_pass(spark, store, sources or [source], prices, clock[0])

    def write(name, text, mode="w"):
        with open(root / name, mode) as f:
            f.write(text)

    return root, store, run, write, source


def keys(store):
    return sorted((r.session_uid, r.call_key) for r in store.read("calls").collect())


def test_lifecycle(world):
    root, store, run, write, source = world
    write("s.jsonl", said(1) + said(2))
    first = run()
    assert (first.version, first.changed) == (1, 1)
    assert keys(store) == [("s", "msg:m1"), ("s", "msg:m2")]

    # Nothing changed: nothing is written.
    assert run().version == 1

    # A half-written record waits for its newline.
    write("s.jsonl", said(3)[:40], "a")
    run()
    assert len(keys(store)) == 2
    write("s.jsonl", said(3)[40:], "a")
    run()
    assert len(keys(store)) == 3
    state = {r.path.split("/")[-1]: r for r in store.read("file_state").collect()}
    assert state["s.jsonl"].consumed == os.path.getsize(root / "s.jsonl")

    # A rewrite drops what the file no longer holds.
    write("s.jsonl", said(7) + said(8) + said(9) + said(10))
    run()
    assert [k for _, k in keys(store)] == ["msg:m10", "msg:m7", "msg:m8", "msg:m9"]

    # A vanished log keeps its rows and is flagged; coming back clears the flag.
    text = (root / "s.jsonl").read_text()
    os.remove(root / "s.jsonl")
    gone = run()
    assert gone.vanished == 1
    row = ingest.sessions(store).first()
    assert row.orphaned and row.calls == 4
    write("s.jsonl", text)
    run()
    assert not ingest.sessions(store).first().orphaned

    # An old version still reads as it was.
    assert store.read("calls", 1).count() == 2

    ingest.forget(store, "s")
    assert store.read("calls").count() == 0


def test_reprice_is_idempotent_and_sessions_follow(world, spark):
    _, store, run, write, _ = world
    write("s.jsonl", said(1) + said(2, name="mystery"))
    run()
    before = ingest.sessions(store).first()
    ingest.reprice_store(store, builtin_prices(spark))
    again = ingest.sessions(store).first()
    assert before.cost_usd == again.cost_usd > 0
    row, calls = ingest.one_session(store, "s")
    assert row.first().cost_usd == again.cost_usd and [r.call_key for r in calls.collect()] == ["msg:m1", "msg:m2"]
    assert ingest.one_session(store, "none")[0].count() == 0
    totals = rollups.totals(store.read("calls"), store.read("tool_calls"), ingest.sessions(store)).first()
    assert (totals.calls, totals.unpriced) == (2, 1)


def test_a_failing_source_leaves_the_others(world, tmp_path):
    _, store, run, write, source = world
    write("s.jsonl", said(1))

    def broken(lines, **_):
        raise RuntimeError("no such format")

    bad_root = tmp_path / "bad"
    bad_root.mkdir()
    (bad_root / "x.jsonl").write_text('{"a":1}\n')
    bad = registry.LogSource("pi", (str(bad_root),), broken)
    result = run([bad, source])
    assert "no such format" in result.errors["pi"]
    assert keys(store) == [("s", "msg:m1")]
    status = {r.agent: r for r in store.read("scan_status").collect()}
    assert "no such format" in status["pi"].error and status["claude"].calls_ingested == 1


def test_discovery(spark, tmp_path):
    root = tmp_path / ".logs"
    for name in ["a.jsonl", "b.JSONL", "c.txt", ".hidden/x.jsonl", "node_modules/y.jsonl", "sub dir/z.jsonl", "_d/w.jsonl"]:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"a":1}\n{"a":2}\nrest')
    found = sorted(os.path.relpath(r.path, root) for r in discover(spark, [str(root), str(tmp_path / "absent")]).collect())
    assert found == ["_d/w.jsonl", "a.jsonl", "b.JSONL", "sub dir/z.jsonl"]
    assert discover(spark, [str(tmp_path / "absent")]).count() == 0
    flat = sorted(os.path.relpath(r.path, root) for r in discover(spark, [str(root)], recurse=False).collect())
    assert flat == ["a.jsonl", "b.JSONL"]


def test_files_are_read_in_splits(spark, tmp_path):
    """Lines are numbered the same way whether a file is one split or many, and none is lost."""
    texts = {
        "a.jsonl": "".join(f'{{"n":{i},"pad":"{"é" * (i % 40)}"}}\n' for i in range(3000)) + '{"half',
        "b c.jsonl": "".join(f'{{"n":{i}}}\r\n' for i in range(2000)),
        "d.jsonl": "no newline at all", "e.jsonl": "", "f+g%20.jsonl": "\n\nx\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("8192", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {(os.path.basename(r.path), r.ordinal): r.line for r in read_lines(spark, [str(tmp_path)], "x").collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {(n, i): x for n, t in texts.items() for i, x in enumerate(t.split("\n")[:-1])}


def test_a_line_of_any_length_is_read(spark, tmp_path):
    big = "x" * (65 << 20)
    (tmp_path / "a.jsonl").write_text('{"a":1}\n' + big + '\n{"a":2}\n')
    got = read_lines(spark, [str(tmp_path)], "x").selectExpr("ordinal", "octet_length(line) AS n").collect()
    assert sorted(map(tuple, got)) == [(0, 7), (1, len(big)), (2, 7)]


def test_deep_and_underscore_names_are_found(spark, tmp_path):
    names = ["_top.jsonl", "a/b/c/d/e/f/_deep/x.jsonl", "a/_mid/_in/y.jsonl", "a/b/_file.jsonl", "a/b/z.jsonl", "_d/_e/_f/_g.jsonl"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"a":1}\n')
    assert sorted(os.path.relpath(r.path, tmp_path) for r in discover(spark, [str(tmp_path)]).collect()) == sorted(names)
    got = sorted(os.path.relpath(r.path, tmp_path) for r in read_lines(spark, [str(tmp_path)], "x").collect())
    assert got == sorted(names)


@pytest.mark.parametrize("entries", [1, 40, 100_000])
def test_any_tree_is_walked_by_tasks(spark, tmp_path, entries, monkeypatch):
    """5,000 directories, wide and deep, in rounds of any size; neither the driver nor Spark's listing looks at one of them."""
    wide = 4900 if entries > 1000 else 150
    deep, want = tmp_path, set()
    for i in range(100 if entries > 1000 else 12):
        deep = deep / ("_under" if i % 7 == 3 else f"level {i}")
        deep.mkdir()
        (deep / f"n%{i}.jsonl").write_text("x\n" * i)
        want.add((str(deep / f"n%{i}.jsonl"), 2 * i))
    for i in range(wide):
        folder = tmp_path / f"w{i % 70}" / f"d{i}"
        folder.mkdir(parents=True)
        if i % 3 == 0:
            (folder / "_s.JSONL").write_text("y")
            want.add((str(folder / "_s.JSONL"), 1))
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.jsonl").write_text("z")
    (tmp_path / ".x.jsonl").write_text("z")

    def none(*_):
        raise AssertionError("listed on the driver")

    monkeypatch.setattr(lines_module, "_existing", none)
    monkeypatch.setattr(lines_module, "_underscored", none)
    monkeypatch.setattr(listing, "ENTRIES", entries)
    found = listing.walk(spark, [str(tmp_path), str(tmp_path / "w3"), str(tmp_path / "none"), f"{deep}/n%1.jsonl"], ".jsonl", True, entries)
    rows = [(r.path, r.size) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert discover(spark, [f"file://{tmp_path}"]).select("path", "size").exceptAll(found.select("path", "size")).isEmpty()


def test_listed_files_are_read_in_ranges(spark, tmp_path):
    """Whatever the length of a range, lines have the numbers they have in the file, and what comes after the listing waits."""
    texts = {"a b.jsonl": "".join("é" * (i % 9) + f"{i}\n" for i in range(400)) + "half", "c%20.jsonl": "\n\n\nx\n", "d.jsonl": "no end", "e.jsonl": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = cut_lineage(discover(spark, [str(tmp_path)]))
    with open(tmp_path / "c%20.jsonl", "a") as f:
        f.write("later\n")
    want = {(n, i): x for n, t in texts.items() for i, x in enumerate(t.split("\n")[:-1])}
    for chunk in (7, 64, 1 << 20):
        got = [((os.path.basename(r.path), r.ordinal), r.line) for r in read_files(files, [str(tmp_path)], "x", chunk=chunk).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_all_changed_logs_come_in_with_one_pass(world):
    root, store, run, write, _ = world
    for i in range(300):
        write(f"s{i}.jsonl", said(1))
    write("half.jsonl", said(2)[:30])
    assert run().changed == 301
    assert store.read("calls").count() == 300
    # Half a line is no news until it grows.
    assert [run().version for _ in range(2)] == [1, 1]


def test_a_rewrite_behind_the_first_lines_is_seen(world):
    root, store, run, write, _ = world
    body = [said(i) for i in range(1, 40)]
    write("s.jsonl", "".join(body))
    run()
    body[35] = said(77)
    write("s.jsonl", "".join(body) + said(50))
    run()
    got = [k for _, k in keys(store)]
    assert "msg:m77" in got and "msg:m50" in got and "msg:m36" not in got and len(got) == 40


def test_a_failing_log_leaves_the_others_of_its_agent(world):
    root, store, run, write, source = world
    for i in range(5):
        write(f"s{i}.jsonl", said(i))

    def picky(lines, **_):
        if lines.filter("path like '%s3.jsonl'").head(1):
            raise RuntimeError("cannot read this one")
        return claude.normalise(lines)

    bad = registry.LogSource("claude", source.roots, picky)
    result = run([bad])
    assert result.changed == 4 and "1 of 5 failed; first: " in result.errors["claude"] and "s3.jsonl" in result.errors["claude"]
    assert sorted({u for u, _ in keys(store)}) == ["s0", "s1", "s2", "s4"]
    assert run([source]).changed == 1 and len(keys(store)) == 5


def test_any_number_of_unreadable_logs_leaves_the_others(world, spark):
    """Logs gone since they were listed, more than a pass used to try and ahead of the good ones."""
    root, store, run, write, source = world
    for i in range(3):
        write(f"s{i}.jsonl", said(i))
    lost = [f"{root}/a{i:02d}.jsonl" for i in range(25)]
    read = []

    def counted(lines, **_):
        read.append(1)
        return claude.normalise(lines)

    class Stale(registry.LogSource):
        def files(self, spark):
            rows = [(p, 10, NOW) for p in lost]
            return super().files(spark).unionByName(spark.createDataFrame(rows, "path STRING, size BIGINT, mtime TIMESTAMP"))

    result = run([Stale("claude", source.roots, counted)])
    assert result.changed == 3 and "25 of 28 failed" in result.errors["claude"] and len(read) <= 3
    assert sorted({u for u, _ in keys(store)}) == ["s0", "s1", "s2"]
    assert sorted(r.path for r in store.read("failures").where("error LIKE '%FileNotFound%'").collect()) == lost
    lost.clear()
    assert run([source]).errors == {} and store.read("failures").count() == 0
    assert store.read("scan_status").first().error == ""


def test_any_number_of_logs_whose_rows_fail_leaves_the_others(spark, monkeypatch):
    paths = [f"/none/{i:03d}" for i in range(100)]
    bad = set(paths[:40]) | {paths[77]}

    def read(source, part, *_):
        names = [r.path for r in part.collect()]
        if bad & set(names):
            raise ValueError("rows")
        return names

    monkeypatch.setattr(ingest, "_read", read)
    monkeypatch.setattr(ingest, "unreadable", lambda files: spark.createDataFrame([], "path STRING, error STRING"))
    picked = spark.createDataFrame([(p,) for p in paths], "path STRING").coalesce(1).cache()
    got, failed = ingest._read_what_can_be(None, picked, None, None)
    assert sorted(p for part in got for p in part) == sorted(set(paths) - bad)
    assert sorted(map(tuple, failed.collect())) == [(p, "ValueError: rows") for p in sorted(bad)]


def test_all_or_nothing_of_a_source(world):
    """Tools fail after calls were read: nothing of the log is stored."""
    from dataclasses import replace

    root, store, run, write, source = world
    write("s.jsonl", said(1))

    def broken(lines, **_):
        rows = claude.normalise(lines)
        return replace(rows, tools=rows.tools.selectExpr("*", "CAST(raise_error('no tools') AS STRING) AS x").where("x is null").drop("x").union(
            rows.tools.sparkSession.createDataFrame([(None,) * 8], rows.tools.schema).selectExpr("*", "raise_error('no tools') AS x").drop("x").where("assert_true(false) is null")))

    result = run([registry.LogSource("claude", source.roots, broken)])
    assert "claude" in result.errors and store.read("calls").count() == 0 and store.read("file_state").count() == 0


def test_two_writers_from_one_base_both_count(world, spark):
    from spendloom.plans.store import OldBaseError

    root, store, run, write, _ = world
    write("s.jsonl", said(1))
    run()
    row = store.read("calls")
    other = Store(spark, store.root)
    base = store.version()
    store.append({"calls": row.selectExpr("'a' AS session_uid", *row.columns[1:])})
    other.append({"calls": row.selectExpr("'b' AS session_uid", *row.columns[1:])})
    assert sorted(u for u, _ in keys(store)) == ["a", "b", "s"]
    with pytest.raises(OldBaseError):
        store.append({"calls": row}, after=base)
    before = keys(store)
    store.compact()
    assert keys(store) == before and len(store._shown(None)) == 1
    assert store.read("calls", base).count() == 1


def test_an_appended_log_writes_its_own_rows_only(world):
    root, store, run, write, _ = world
    for i in range(50):
        write(f"s{i}.jsonl", "".join(said(j) for j in range(20)))
    run()
    write("s7.jsonl", said(30), "a")
    run()
    newest = store.passes()[-1]["pass"]
    assert store.deltas("calls").where(f"pass = '{newest}'").count() <= 21


def test_gemini_project_side_file(spark, lines_of):
    line = json.dumps({"type": "gemini", "timestamp": "2026-01-01T00:00:00Z", "tokens": {"input": 5}})
    files = spark.createDataFrame([("/h/history/proj/.project_root", bytearray(b"/home/me/proj\n"))], "path STRING, content BINARY")
    rows = gemini.normalise(lines_of([line], "/h/tmp/proj/chats/s.jsonl"), roots=gemini.project_roots(files))
    assert rows.calls.first().project == "/home/me/proj"
    rows = gemini.normalise(lines_of([line], "/h/tmp/other/chats/s.jsonl"), roots=gemini.project_roots(files))
    assert rows.calls.first().project == "other"
    rows = gemini.normalise(lines_of([line], "/h/tmp/s.jsonl"))
    assert (rows.calls.first().project, rows.calls.first().session_uid) == ("", "s")


def test_append_equals_full_read(world):
    """Split a log at any line: reading it in two passes gives what one pass gives."""
    _, store, run, write, _ = world
    body = [said(i, tokens=i * 10) for i in range(1, 6)]
    write("s.jsonl", "".join(body[:2]))
    run()
    write("s.jsonl", "".join(body[2:]), "a")
    run()
    write("t.jsonl", "".join(body))
    run()
    rows = {}
    for r in store.read("calls").collect():
        rows.setdefault(r.session_uid, set()).add((r.call_key, r.ts, r.input_tokens, r.llm_seconds, r.cost_usd))
    assert rows["s"] == rows["t"] and len(rows["s"]) == 5


def test_registry_covers_the_log_agents(spark, tmp_path):
    assert [s.agent for s in registry.log_sources(str(tmp_path))] == ["pi", "claude", "codex", "gemini"]
    assert registry.NORMALISERS["pi"] is pi.normalise
