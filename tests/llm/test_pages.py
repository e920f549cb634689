"""HTML extraction, WARC archives and quotation links."""

import gzip
import hashlib
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendloom.llm import html_text, quotes, warc
from spendloom.llm.queries import ORACLE

PAGE = """<!DOCTYPE html><html><head><title>Out</title><style>p{}</style></head><body class="menu-open">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-banner">We use cookies.</div>
<div id=content><article><header><h1>Title &amp; more</h1></header><p>First   paragraph with <b>bold</b> and a <a href=x>link</a> in it.
Second line.<p>Another paragraph, &eacute;t&#233;, of quite some length so that it counts.<br>After the break.</p>
<script>var x = "<p>no</p>";</script><div class="ad-slot">Buy this</div><ul><li>One item of the list<li>Two items of the list</ul>
<table><tr><td>cell one<td>cell two</table></article>
<div class="comments"><p>Reader says something long enough to look like an article, or nearly so.</p></div></div>
<aside>Related things</aside><form><label>Mail</label><input></form><footer>&copy; nobody</footer></body></html>"""


def test_main_blocks():
    assert html_text.main_blocks(PAGE) == [
        "Title & more", "First paragraph with bold and a link in it. Second line.",
        "Another paragraph, été, of quite some length so that it counts. After the break.",
        "One item of the list", "Two items of the list", "cell one", "cell two"]


def test_siblings_above_the_threshold_stay_and_link_lists_go():
    text = "Words that make up a paragraph of some length, with a comma. " * 3
    page = f"<body><div><p>{text}</p><p>{text}</p></div><div><p>{text}</p></div><div>" + "<a href=x>link</a> " * 30 + "</div></body>"
    assert html_text.main_blocks(page) == [text.strip()] * 3


@pytest.mark.parametrize("wrap", [
    '<form id=aspnetForm><input type=hidden value=x>{}<label>Mail</label></form>', '<div class="has-sidebar">{}</div>', '<div class="with-sidebar">{}</div>',
    '<div class="no-banner no-comments">{}</div>', '<div id=social-feed>{}</div>', '<section class=widget><div class=header>{}</div></section>',
])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_an_article_outlives_the_names_around_it(wrap, inner):
    text = "Words that make up a paragraph of some length, with a comma. " * 3
    page = inner.format(f"<p>{text}</p><p>{text}</p><div class=share-bar>Share this</div>")
    got = html_text.main_blocks("<body>" + wrap.format(page + '<div class="sidebar">Beside it</div>') + "<div class=related><article>Other</article></div></body>"
                                if "main" in inner else "<body>" + wrap.format(page + '<div class="sidebar">Beside it</div>') + "</body>")
    assert got == [text.strip()] * 2


def test_comments_stay_out_however_long():
    text = "Words that make up a paragraph of some length, with a comma. " * 3
    said = "<article class=comment><p>" + text * 4 + "</p></article>"
    assert html_text.main_blocks(f"<body><article><p>{text}</p></article><div class=comments>{said * 3}</div></body>") == [text.strip()]


@pytest.mark.parametrize("tag", ["h1", "h6"])
def test_linked_headings_below_the_body_stay(tag):
    text = "Words that make up a paragraph of some length, with a comma. " * 3
    head = f"<{tag}><a href=x>The title of this page</a></{tag}>"
    assert html_text.main_blocks(f"<body>{head}<p>{text}</p><p>{text}</p></body>") == ["The title of this page"] + [text.strip()] * 2


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<p", "<script>never closed", "</div></p>"])
def test_pages_without_text(html):
    assert html_text.main_blocks(html) == []


def test_broken_and_deep_pages():
    assert html_text.main_blocks("just words") == ["just words"]
    assert html_text.main_blocks("<div>" * 5000 + "deep" + "</div>" * 10) == ["deep"]
    assert html_text.main_blocks("<p><b>one<br><p>two</b><p>three &am") == ["one", "two", "three &am"]


@pytest.mark.parametrize("head, often, tail", [
    ("<b><div>", "<i>", "</b>"), ("", "<div class=header>", "</div>"), ("<ul>", "<i>", "<li>x"), ("", "<i>", "<hr>x"), ("<table>", "<i>", "<td>x"),
])
def test_open_elements_in_linear_time(head, often, tail):
    """Many open elements and as many tags that look for one: a page of about a million characters is done in seconds."""
    start = time.monotonic()
    html_text.main_blocks(f"<p>An article.</p>{head}{often * 60_000}{tail * 60_000}<p>Its end.</p>")
    assert time.monotonic() - start < 30


def test_main_texts(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "words", "x"), (1, "u", PAGE, "x")],
                                  "page_id BIGINT, url STRING, html STRING, text STRING")
    got = html_text.main_texts(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got} == {"\n\n".join(html_text.main_blocks(PAGE)), "", "words"}
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_captures_round_trip(spark):
    long = "<p>" + "é" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(3, "http://a/x", long), (1, "http://a/y\r\nWARC-Type: z", long), (2, None, long), (4, "http://b", "short"), (5, "http://b", "short"),
            (6, "http://c", None), (7, "http://c", ""), (4, "http://b", "short"), (None, "http://d", long), (8, "http://e", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id BIGINT, url STRING, html STRING, record_id STRING, digest INT")
    got = warc.page_captures(spark, pages).collect()
    assert len(got) == len(set(rows))
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in by.items() if r.payload_bytes > 99} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1), 8: ("response", None)}
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 100)
    assert warc.page_captures(spark, pages.limit(0)).count() == 0


def record(kind, ident, block, **fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + ident.encode()]
    for name, values in fields.items():
        head += [name.replace("_", "-").encode() + b": " + v.encode() for v in ([values] if isinstance(values, str) else values)]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def test_foreign_archives_are_assembled(spark, tmp_path):
    """Links may run from response to request, and reach metadata by way of either; members may be many."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: x\r\n\r\n"
    body = bytes(range(256)) + b"\r\n\r\nWARC/1.0\r\n"
    media = "application/http; msgtype=response"
    one = [
        record("warcinfo", "<w>", b"software: x\r\n"),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("response", "<r1>", http + body, WARC_Concurrent_To="<q1>", Content_Type=media),
        record("metadata", "<m1>", b"fetch: 1", WARC_Concurrent_To="<q1>"),
        record("metadata", "<m2>", b"more: 2", WARC_Concurrent_To=["<r1>", "<q1>"]),
    ]
    two = [record("response", "<r2>", http, Content_Type=media), record("metadata", "<lost>", b"a: b", WARC_Concurrent_To="<none>"),
           record("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r2>", Content_Type="application/http; msgtype=request")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "b.warc").write_bytes(b"".join(two))
    got = {r.record_id: r for r in warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert bytes(got["<r1>"].response.payload) == body and got["<r1>"].response.payload_digest == hashlib.sha256(body).hexdigest()
    assert got["<r1>"].request.record_id == "<q1>" and [m.record_id for m in got["<r1>"].metadata] == ["<m1>", "<m2>"]
    assert got["<r2>"].request.record_id == "<q2>" and got["<r2>"].metadata == [] and got["<r2>"].response.payload_bytes == 0


CHAT = [
    (1, 0, "user", "Hello there.\n\nHow does one pack bins?\nWell?"), (1, 1, "assistant", "Use best fit.\nOr first fit."),
    (1, 2, "user", "Ann wrote:\n> Use best  FIT.\n> Or first fit.\n\nWhy not sum of squares?"),
    (1, 3, "assistant", ">> Use best fit.\n> Why not sum of squares?\nThat works too."), (1, 4, "user", "> > > How does one pack bins?\nonly deep"),
    (1, 5, "user", "> never said this\nok"), (2, 0, "user", "> Use best fit.\nno such here"), (2, 1, "user", None), (2, 2, "user", ""),
    (2, 3, "user", ">"), (None, 1, "user", "> x"), (3, None, "user", "plain"), (4, 0, "a", "common line\n"), (4, 1, "b", "common line"),
    (4, 2, "c", "> common line\r\nyes"), (4, 3, "d", "> yes\nand > not a quote"), (4, 4, "d", "> and > not a quote\n>  yes\nend"),
    (4, 4, "d", "> and > not a quote\n>  yes\nend"), (5, 0, "a", "long " * 50_000), (5, 1, "b", "> " + "long " * 50_000 + "\nindeed"),
]


def test_quotes_link_as_in_sql(spark):
    rows = [(*r, "clash", "clash", 1) for r in CHAT]
    messages = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, hash STRING, quotes STRING, level INT")
    got = quotes.linked(messages)
    con = duckdb.connect()
    table = pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", table)
    want = con.execute(ORACLE["op10_quotation_links"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert by[1, 3].reply_to == 2 and by[1, 3].depth == 2 and by[1, 3].text == "That works too."
    assert by[4, 4].reply_to == 3 and by[4, 4].thread == 0 and by[5, 1].reply_to == 0
    assert quotes.linked(messages.limit(0)).count() == 0


def test_long_chains(spark):
    rows = [(1, i, "u", (f"> point {i - 1}.\n" if i else "") + f"point {i}.") for i in range(70)]
    got = quotes.linked(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).collect()
    assert all(r.thread == 0 and r.depth == r.turn and r.text == f"point {r.turn}." for r in got)


@pytest.mark.parametrize("text", [
    "> q\n" + "\n" * 1_000_000 + "x", ">" * 1_000_000, "> " * 300_000 + "q", "> q\n" + " \n\t" * 300_000 + "x", "> q\nwrote: " * 2 + "wrote: " * 150_000 + "x",
    "> q\n" + " " * 1_000_000 + "x",
])
def test_long_quotes(spark, text):
    """Very many line ends, marks, blanks and announcements neither end the executor nor take more than linear time."""
    rows = [(1, 1, "u", "q"), (1, 2, "a", text), (2, 1, "u", text)]
    got = quotes.linked(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).collect()
    assert len(got) == 3 and all(r.thread is not None for r in got)


def test_reply_order(spark):
    rows = [(1, 1, "u", "first"), (1, 2, "a", "> first\nsecond"), (1, 3, "u", "apart"), (1, 4, "a", "> second\nthird"), (1, 5, "u", "> first\nfourth"), (1, 6, "a", "> apart\nx"), (1, 6, "a", "> apart\ny")]
    got = quotes.linked(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).collect()
    order = sorted({(r.thread, r.position, r.turn) for r in got})
    assert order == [(1, 0, 1), (1, 1, 2), (1, 2, 4), (1, 3, 5), (3, 0, 3), (3, 1, 6)]
