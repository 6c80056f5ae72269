"""Operators on small fixtures with results worked out by hand or by another engine."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars, urls
from palimpsest.operators import difference, extract, filters, gates, history, index, rollup, search, shapes
from palimpsest.sources import feeds, lines, ranges, records, warc
from palimpsest.streaming import machines


def one(spark, expr, **columns):
    """The value of an expression over one row of strings."""
    names = list(columns) or ["_"]
    row = spark.createDataFrame([tuple(columns.values()) or ("",)], ", ".join(f"{n} string" for n in names))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://Example.COM:80/a/", "http://example.com/a"),
        ("https://example.com:443", "https://example.com"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com:8080/x?b=2&a=1#frag", "https://example.com:8080/x?a=1&b=2"),
        ("http://example.com/x?utm_source=f&fbclid=1&q=", "http://example.com/x?q="),
        ("http://user:pw@example.com/x?m=1", "http://example.com/x"),
        ("  not a url ", "not a url"),
    ],
)
def test_canonical_urls(spark, raw, want):
    assert one(spark, urls.canonical(F.col("u")), u=raw) == want
    assert urls.canonical_text(raw) == want


def test_canonical_form_is_stable():
    for raw in ("http://a.b/x?q=%C3%A9&A=1", "http://a.b/x?q=a+b", "https://h:99/p/?z=&y"):
        once = urls.canonical_text(raw)
        assert urls.canonical_text(once) == once


def test_url_parts(spark):
    u = "https://www.Blog.example.co.uk:8443/A/b.html?y=2&x=&y=1#f"
    assert one(spark, urls.host(F.col("u")), u=u) == "www.blog.example.co.uk"
    assert one(spark, urls.query_keys(F.col("u")), u=u) == ["x", "y"]
    assert one(spark, urls.registrable(urls.host(F.col("u"))), u=u) == "example.co.uk"
    assert one(spark, urls.surt(F.col("u")), u=u) == "uk,co,example,blog:8443)/a/b.html?x=&y=1&y=2"
    assert one(spark, urls.suffixes(F.col("u")), u="a.b.c") == ["a.b.c", "b.c", "c"]
    assert one(spark, urls.under(F.col("u"), "*.b.c"), u="a.b.c") and one(spark, urls.under(F.col("u"), "*.b.c"), u="b.c")
    assert not one(spark, urls.under(F.col("u"), "*.b.c"), u="ab.c")
    assert one(spark, urls.visited_key(F.col("u")), u="HTTP://A.b/x/") == "http://a.b/x"
    assert urls.absolute("http://a.b/c/d", "../e#f") == "http://a.b/e" and urls.absolute("http://a.b", "mailto:x") is None


def test_shapes_of_a_blog(spark):
    rows = ["http://b.c/"] + [f"http://b.c/2019/05/post-{i}.html" for i in range(40)] + [f"http://b.c/img/{i:x}cafe.jpg" for i in range(40)]
    rows += [f"http://b.c/search/label/l{'x' * (i % 60)}?updated-max={i}&max=20" for i in range(480)]
    table = spark.createDataFrame(list(enumerate(rows)), "id long, url string")
    got = {r["shape"]: r.n for r in shapes.summary(shapes.shaped(table)).collect()}
    assert got == {"/": 1, "/#/#/*.html": 40, "/img/*.jpg": 40, "/search/label/*?max&updated-max": 480}


def plain_shapes(rows, most_values, most_nodes):
    """The shapes of (id, path segments) by a plain loop over a tree."""
    tree = {}
    for _, segments in rows:
        for i, s in enumerate(segments):
            at = tuple(segments[:i])
            if at not in tree:
                if len(tree) >= most_nodes:
                    break
                tree[at] = [0, set()]
            tree[at][0] += 1
            tree[at][1].add(s)
    out = {}
    for k, segments in rows:
        parts = []
        for i, s in enumerate(segments):
            uses, values = tree.get(tuple(segments[:i]), (0, None))
            parts.append("*" if values is None or len(values) >= most_values or len(values) > 8 and len(values) > uses * 0.05 else s)
        out[k] = "/" + "/".join(parts)
    return out


@pytest.mark.parametrize("most_values, most_nodes", [(2000, 50_000), (30, 50_000), (2000, 25), (30, 12), (1, 1)])
def test_shapes_above_the_bounds(spark, most_values, most_nodes):
    rng = random.Random(most_nodes)
    rows = [(i, [rng.choice("abc") + "x", f"w{rng.choice('pqrstuv')}v{rng.choice(['', 'y', 'z'])}", f"page{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(4))}q"][: rng.randrange(1, 4)]) for i in range(3000)]
    table = spark.createDataFrame([(k, "http://b.c/" + "/".join(s)) for k, s in rows], "id long, url string").repartition(5)
    got = {r.id: r["shape"] for r in shapes.shaped(table, most_values=most_values, most_nodes=most_nodes).collect()}
    assert got == plain_shapes(rows, most_values, most_nodes)
    assert shapes.shaped(table.limit(0)).count() == 0


def test_scalars(spark):
    assert one(spark, scalars.words(F.col("t")), t="  a b c \n") == 3 and one(spark, scalars.words(F.col("t")), t="  ") == 0
    assert one(spark, scalars.iso_of_cdx(F.col("t")), t="202401") == "2024-01-00T00:00:00Z"
    assert one(spark, scalars.cdx_timestamp(F.col("t")), t="2024-01-02T03:04:05Z") == "20240102030405"
    assert one(spark, scalars.capture_of(F.col("t")), t="captures/x/a.warc.gz") == "x" and one(spark, scalars.capture_of(F.col("t")), t="x/y") == ""
    assert [one(spark, scalars.number_text(F.col("t").cast("double")), t=t) for t in ("3", "2.5")] == ["3", "2.5"]
    assert [one(spark, scalars.backoff_minutes(F.lit(30), F.col("t").cast("int")), t=t) for t in "0129"] == [30, 60, 120, 1440]
    assert [one(spark, scalars.retry_minutes(F.col("t").cast("int")), t=t) for t in ("1", "3", "20")] == [10, 40, 1440]
    assert [one(spark, scalars.lockout_seconds(F.col("t").cast("int")), t=t) for t in ("4", "5", "7", "30")] == [0, 60, 240, 3600]
    assert scalars.slug_text("Héllo,  Wörld!") == "hello-world" and scalars.slug_text("???") == "site" and scalars.slug_text("Con") == "con-x"
    assert [one(spark, scalars.quiet(F.col("t").cast("int"), 1380, 390), t=t) for t in ("1400", "10", "390")] == [True, True, False]


# pages


def test_text_of_a_page():
    html = """<html><head><title> A
      title</title></head><body><nav><p>Menu entry of the site</p></nav><div class="post-footer"><p>Posted by somebody here</p></div>
      <div class="entry-header"><h1>The heading of it</h1></div><p>First paragraph &amp; more<br>second line of it</p><ul><li>An item of the list</li></ul>
      <script>var x = "<p>not text at all</p>";</script><p>short</p><blockquote>Quoted words here</blockquote></body></html>"""
    title, found, kinds = extract.blocks_of(html)
    assert title == "A title"
    assert list(zip(kinds, found)) == [("h1", "The heading of it"), ("p", "First paragraph & more"), ("p", "second line of it"), ("li", "An item of the list"), ("quote", "Quoted words here")]
    assert extract.blocks_of(None) == ("", [], [])
    odd = """</div><div id=Main_Sidebar><p>Left out, twice over</div><p>Still inside of it</p></div><p>Text after the side</p><form>Not this one at all<br/></form>
      <td role="x content y" class="nav">Kept for its content word<br/>And after an empty break <svg><title>T</title>gone</svg></td><header>Header elements are kept"""
    assert extract.blocks_of(odd) == ("T", ["Text after the side", "Kept for its content word", "And after an empty break", "Header elements are kept"], ["p"] * 4)
    assert extract.blocks_of("<p>" + "a" * 119_999 + "<p>" + "b" * 20 + "<p>" + "c" * 20, None)[1][1:] == ["b" * 20, "c" * 20]
    assert extract.blocks_of("<p>" + "a" * 119_999 + "<p>" + "b" * 20 + "<p>" + "c" * 20)[1][1:] == ["b" * 20]


def test_charsets():
    assert extract.decoded("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    assert extract.decoded(b'<meta charset="iso-8859-1">\xe9') == '<meta charset="iso-8859-1">é'
    assert extract.decoded("é".encode(), "text/html; charset=nonsense") == "é" and extract.decoded(b"\xff") == "�"


def test_template_blocks_go(spark):
    rows = [(i, "T", ["Sidebar on all pages", f"Text of page {i}"], ["p", "h1"], "s") for i in range(4)] + [(9, "T", ["Sidebar on all pages"], ["p"], "t")]
    pages = spark.createDataFrame(rows, "page_id long, title string, blocks array<string>, kinds array<string>, site string")
    got = {r.page_id: (r.blocks, r.kinds, r.dropped) for r in extract.without_template(pages, "site").collect()}
    assert got == {**{i: ([f"Text of page {i}"], ["h1"], 1) for i in range(4)}, 9: (["Sidebar on all pages"], ["p"], 0)}


def test_references_of_a_page():
    html = r"""<base href="/b/"><link rel="alternate" type="application/atom+xml" href="feed.xml"><link rel="canonical" href="/c"><link rel=next href='/n'>
      <link rel="stylesheet" href="s.css"><style>@import "i.css"; a{background:url(https\:\/\/cdn.x\/bg.png)}</style><a href="p#top">p</a><a href="mailto:x@y">m</a>
      <img src="i.png" srcset="i2.png 2x, i3.png 640w" data-src="z"><script src="//t.x/a.js">var u = "http://no.no/";</script><video src="v.mp4"></video><meta name="generator" content="G 1">"""
    got = extract.references(html, "http://h.x/a/")
    assert got["links"] == {"http://h.x/b/p"} and list(got["feeds"]) == ["http://h.x/b/feed.xml"] and got["canonical"] == "http://h.x/c"
    assert got["assets"] == {f"http://h.x/b/{n}" for n in ("s.css", "i.css", "i.png", "i2.png", "i3.png", "v.mp4")} | {"https://cdn.x/bg.png", "http://t.x/a.js"}
    assert got["escaped"] == {"https://cdn.x/bg.png"} and list(got["media"]) == ["http://h.x/b/v.mp4"] and got["generator"] == "G 1" and got["lazy"] == 1


def test_gates(spark):
    overlay = '<iframe src="https://www.blogger.com/interstitial/blog?u=x"></iframe><style>body * { visibility: hidden }</style>' + "x" * 30000
    cases = {"overlay": (overlay, "http://a.b/"), "url": ("", "http://a.b/interstitial/x"), "phrase": ("Content Warning", "http://a.b/"), "clear": ("Content Warning" + "x" * 30000, "http://a.b/")}
    for want, (html, url) in cases.items():
        assert one(spark, gates.verdict(F.col("h"), F.col("u")), h=html, u=url) == want
    frame, hidden = '<IFRAME id="a"\n src = \'http://x/blogger.com/interstitial/\'>', "<style>p { color: red }\nBODY  *\n{ margin: 0; Visibility :\nhidden; }</style>"
    both = {frame + hidden: True, frame: False, hidden: False, frame.replace("interstitial", "x").replace("blogger.com", "b") + hidden: False, frame + "<style>body { visibility: hidden }</style>": False, frame + "<style>body * { color: red } p { visibility: hidden }</style>": False}
    for html, want in both.items():
        assert one(spark, gates.overlaid(F.col("h")), h=html) == want


# sources


def test_warc_files(spark, tmp_path):
    page = lambda url, body, status=200, kind="text/html": {"url": url, "status": status, "headers": {"Content-Type": kind}, "body": body}
    first = warc.encode([{"rec_type": "warcinfo", "body": b"x"}, page("http://a/", b"<p>old"), page("http://a/i.png", b"\x89", kind="image/png"), page("http://a/404", b"no", 404)])
    second = warc.encode([page("http://a/", b"<p>new"), page("http://b/", b"\r\n\r\ntwo")], compress=False)
    (tmp_path / "x.warc.gz").write_bytes(first)
    (tmp_path / "y.warc").write_bytes(second)
    (tmp_path / "z.warc.gz").write_bytes(first[:60] + b"broken")
    rows = records.read(spark, str(tmp_path))
    assert rows.count() == 6
    got = {r.url: bytes(r.body) for r in warc.pages(rows).collect()}
    assert got == {"http://a/": b"<p>new", "http://b/": b"\r\n\r\ntwo"}


def text(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line long, value string")


def test_line_formats(spark, tmp_path):
    good = 'com,x)/ 2024 {"url": "http://x.com/", "mime": "text/html", "status": "200", "offset": "7", "length": 9}'
    got = lines.cdxj(text(spark, good, "broken", "a b {broken", 'a b {"url": "u", "status": "-"}')).collect()
    assert [(r.urlkey, r.url, r.status, r.offset, r.length) for r in got] == [("com,x)/", "http://x.com/", 200, 7, 9), ("a", "u", None, 0, 0)]
    log = text(spark, "2026-08-11 16:58:27 URL:http://h/p [9/9] -> x", "http://h/missing:", "2026-08-09 14:25:35 ERROR 404: Not Found.", "http://h/z:", "connect failed: Connection refused.")
    assert [tuple(r) for r in lines.log_errors(log.withColumn("file", F.lit("f"))).orderBy("url").collect()] == [("http://h/missing", "404: Not Found."), ("http://h/z", "Connection refused.")]
    assert [r.u for r in log.select(lines.log_url(F.col("value")).alias("u")).where("u IS NOT NULL").collect()] == ["http://h/p"]
    jar = text(spark, "# comment", "", ".x.com\tTRUE\t/\tFALSE\t0\ta\tb", "#HttpOnly_y.com\tTRUE\t/\tFALSE\t50\ta\tb", "y.com\tTRUE\t/\tFALSE\t500\ta\tb", "bad line")
    assert tuple(lines.cookies(jar, 100).first()) == (3, 1, 1, 1, 50, 2)
    (tmp_path / "f").write_text('{"url": "a", "blocks": ["é"]}\n{broken\n{"url": "b"}\n')
    pages = lines.pages(ranges.read_lines(spark, f"file://{tmp_path}"))
    assert [(r.url, r.offset, r.length) for r in pages.orderBy("offset").collect()] == [("a", 0, 31), ("b", 39, 13)]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /search\nDisallow:\n\nUser-agent: Bad\nDisallow: /\n\nSitemap: https://x/s.xml\nDisallow: /about\nSitemap: /rel.xml"
    got = one(spark, lines.robots(F.col("t")), t=body)
    assert got.sitemaps == ["https://x/s.xml"] and got.disallowed == ["/about", "/search"]


def test_feeds_and_sitemaps(spark):
    rss = b"""<rss><channel><title>T</title><item><guid>g1</guid><link>http://a/1?utm_x=1</link><title>One</title><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><link>http://a/2/</link></item><item><title>no link</title></item></channel></rss>"""
    atom = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>i</id><link rel="self" href="http://a/self"/><link href="http://a/e"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>"""
    bodies = spark.createDataFrame([("r", rss), ("a", atom), ("j", b'{"items": [{"id": "x", "url": "http://a/j"}]}'), ("n", b"<html/>"), ("e", None)], "url string, body binary")
    got = sorted((r.url, r.kind, r.guid, r.canonical, r.published, r.updated) for r in feeds.read_feeds(bodies).collect())
    assert got == [("a", "atom", "i", "http://a/e", None, "2024-01-02T03:04:05Z"), ("j", "json", "x", "http://a/j", None, None), ("r", "rss", "g1", "http://a/1", "2024-01-02T03:04:05Z", None), ("r", "rss", "http://a/2", "http://a/2", None, None)]
    maps = spark.createDataFrame([("m", b'<urlset xmlns="x"><url><loc> http://a/1 </loc><lastmod>2024</lastmod></url><url/></urlset>'), ("i", b"<sitemapindex><sitemap><loc>http://a/c.xml</loc></sitemap></sitemapindex>"), ("x", b"nope")], "url string, body binary")
    assert sorted(map(tuple, feeds.read_sitemaps(maps).drop("place").collect())) == [("i", "http://a/c.xml", None, True), ("m", "http://a/1", "2024", False)]


def test_entries_leave_python_in_parts(spark):
    items = lambda n: "".join(f"<item><link>http://a/{i}/</link></item>" for i in range(n))
    bodies = spark.createDataFrame([(str(k), f"<rss>{items(3000)}</rss>".encode()) for k in range(8)], "url string, body binary").coalesce(1)

    rows = feeds.read_feeds(bodies)
    assert rows.where("canonical = guid AND NOT endswith(canonical, '/')").count() == 24000
    assert "pandas" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_row_is_rendered_for_one_kind_of_feed(spark):
    from palimpsest.plans import formats

    plan = formats._feeds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_collect_list(") == 1


# search


CORPUS = [(1, "apple pie", "an apple pie with apples and cream, an apple"), (2, "banana", "banana split and apple sauce"), (3, "Café", "the café serves apple pie daily pie"), (4, "none", "nothing of the kind here"), (5, "pie chart", "a chart is not a pie, foo-bar foo bar"), (6, "x", "pie apple"), (7, "y", "filler words only in this one"), (8, "z", "more filler text to read")]


@pytest.mark.parametrize("asked, fts", [("apple", '"apple"'), ('"apple pie"', '"apple pie"'), ("apple pie", '"apple" "pie"'), ("app*", '"app"*'), ("cafe", '"cafe"'), ("foo-bar", '"foo-bar"'), ("pie -chart", '"pie" NOT "chart"'), ("filler -words", '"filler" NOT "words"')])
def test_scores_are_those_of_a_search_engine(spark, asked, fts):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, body, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", CORPUS)
    want = dict(db.execute("SELECT rowid, -bm25(t, 10.0, 1.0) FROM t WHERE t MATCH ?", (fts,)))
    docs = spark.createDataFrame(CORPUS, "id long, title string, body string")
    postings = search.postings(docs, "id", {"title": "title", "body": "body"})
    lengths = postings.groupBy("id").agg(F.sum(F.size("positions")).alias("dl"))
    got = dict(map(tuple, search.scored(postings, lengths, search.parsed(asked), "id").collect()))
    assert set(got) == set(want)
    if "NOT" not in fts:
        assert got == pytest.approx(want)


def test_the_query_language():
    assert search.parsed("-a b").empty and search.parsed("").empty and search.parsed('""').empty
    q = search.parsed('AND "two  words" pre* -not -')
    assert q.terms == ("AND", "two words", "pre", "-") and q.negated == ("not",)
    assert [(t.tokens, t.prefix, n) for t, n in q.groups][:4] == [(("and",), False, False), (("two", "words"), False, False), (("pre",), True, False), (("not",), False, True)]


def test_excerpts(spark):
    body = "x" * 200 + " needle " + "y" * 300 + " other " + "z" * 300
    of = lambda b, terms: one(spark, search.excerpt(F.col("b"), terms), b=b)
    got = of(body, ["needle", "OTHER", "absent"])
    assert len(got) == 2 and all(g.startswith("…") and g.endswith("…") for g in got)
    assert of("short text", ["none"]) == ["short text"] and of("", ["a"]) == [] and of("a  b", []) == ["a b"]
    assert of("one  two three", ["two", "ONE"]) == ["one two three"]
    assert [len(x) for x in of(("k" + "." * 400).join("abcdef"), ["bk", "ck", "dk", "ek"])] == [184] * 3


# history, filters, machines


def test_retention_precedence(spark):
    rows = [(i, 1, f"2024-{i:02d}-10 00:00:00", "ok") for i in range(1, 13)] + [(20, 1, "2024-05-20 00:00:00", "failed"), (30, 2, "2024-01-01 00:00:00", "ok")]
    captures = spark.createDataFrame(rows, "id long, site_id long, t string, status string").withColumn("started_at", F.col("t").cast("timestamp_ntz"))
    held = spark.createDataFrame([(2,), (11,)], "capture_id long")
    plan = history.retention_plan(captures, held, spark.createDataFrame([(3,)], "capture_id long"), "2025-01-01", keep_last=2, keep_monthly=3)
    got = {r.capture_id: r.reason for r in plan.collect()}
    assert got == {1: "first", 2: "last-copy", 3: "dedup-source", **{i: "prunable" for i in (4, 5, 6, 7)}, 8: "monthly", 9: "monthly", 10: "monthly", 11: "newest", 12: "newest", 20: "running", 30: "first"}
    asked = spark.createDataFrame([(4,), (1,), (99,)], "capture_id long")
    assert {r.capture_id: r.deleted for r in history.apply_plan(asked, plan).collect()} == {4: True, 1: False, 99: False}


def test_last_copies_and_sources(spark):
    captures = spark.createDataFrame([(i, 1, f"2024-0{i}-01") for i in (1, 2, 3)], "id long, site_id long, t string").withColumn("started_at", F.col("t").cast("timestamp_ntz"))
    held = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", None), (2, "c", None), (2, "d", "timeout"), (3, "a", None), (3, "e", None)], "capture_id long, url string, error string")
    assert sorted((r.capture_id, r.urls, r.example) for r in history.last_copies(captures, held).collect()) == [(1, 1, "b"), (2, 1, "c")]
    records = spark.createDataFrame([(1, "u", "x", False), (2, "u", "x", False), (3, "u", "x", True), (1, "w", "y", True), (2, "w", "y", False)], "capture_id long, url string, digest string, revisit boolean")
    assert [tuple(r) for r in history.dedup_sources(captures, records).collect()] == [(1, 1)]


def test_filters(spark):
    f = filters.SiteFilter.from_params({"tags": "a,b", "tag_mode": "all", "has_errors": "false", "min_size": "5", "q": ""})
    assert filters.SiteFilter.from_params(f.to_dict()) == f and f.has_errors is False and f.q is None
    with pytest.raises(ValueError):
        filters.SiteFilter(sort="nonsense")
    assert one(spark, filters.contains(F.col("t"), "0%_"), t="10%_X") and not one(spark, filters.contains(F.col("t"), "0%_"), t="100x")
    assert one(spark, filters.in_subtree(F.col("t"), "a"), t="a/b") and not one(spark, filters.in_subtree(F.col("t"), "a"), t="ab")


def test_queue_takes_one_job_per_host(spark):
    jobs = spark.createDataFrame([(1, "h", 5, 1), (2, "h", 1, 2), (3, None, 9, 1), (4, None, 9, 2), (5, "busy", 0, 0)], "id long, host string, priority int, queued_at int")
    assert [r.id for r in history.claimed(jobs, spark.createDataFrame([("busy",), (None,)], "host string"), 3).collect()] == [2, 3, 4]


def test_health_needs_two_that_agree():
    state, out = None, []
    for seen in ["live", "gone", "live", "gone", "moved", "gone", "gone", "gone", "live", "live"]:
        state, changed = machines.health_step(state, seen)
        out.append(changed)
    assert out == [None] * 6 + ["gone", None, None, "live"]


def test_feeds_are_disabled_after_ten_failures():
    state = None
    did = []
    for ok in [True, True] + [False] * 11:
        state, what = machines.feed_step(state, ok)
        did.append(what)
    assert did == ["baseline", "polled"] + ["failed"] * 9 + ["disabled", "disabled"]


def test_differences():
    assert [c["words"] for n in (3, None, 9) for c in difference.changes(["a b c d"], ["a b c e"], n)[0]] == [[], *[[{"op": "replace", "before": "d", "after": "e"}]] * 2]
    made, ratio = difference.changes(["a b", "same", "gone"], ["a c", "same", "new one", "two"])
    assert [(m["kind"], m["before"], m["after"]) for m in made] == [("changed", "a b", "a c"), ("changed", "gone", "new one"), ("added", "", "two")]
    assert made[0]["words"] == [{"op": "replace", "before": "b", "after": "c"}] and ratio == 0.75


def test_index_patterns(spark):
    rows = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("",), (None,)], "url string")
    assert index.without(rows, ["/1$", "(bad"]).count() == 3 and index.without(rows, ["(bad"]).count() == 4
    assert index.usable([" a ", "a", "", "("]) == ["a"]


def test_folder_tree(spark):
    folders = spark.createDataFrame([(1, "a"), (2, "a/b"), (3, "a/b/c"), (4, "d")], "id long, path string")
    sites = spark.createDataFrame([(1, 2, 10, False), (2, 3, 5, False), (3, 3, 7, True)], "id long, folder_id long, size_bytes long, deleted boolean")
    got = {r.path: (r.sites, r.bytes, r.total_sites, r.total_bytes) for r in rollup.folder_tree(sites, folders).collect()}
    assert got == {"a": (0, 0, 2, 15), "a/b": (1, 10, 2, 15), "a/b/c": (1, 5, 1, 5), "d": (0, 0, 0, 0)}


def test_random_histories_agree_with_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(k, i, i, rng.choice(["live", "gone", "moved"])) for k in range(5) for i in range(40)]
    got = sorted(map(tuple, machines.health_changes(spark.createDataFrame(rows, "key long, id long, ts long, seen string")).collect()))
    want = []
    for k in range(5):
        now, pending, n = None, None, 0
        for _, i, _, seen in sorted(r for r in rows if r[0] == k):
            if now is None or seen == now:
                now, pending, n = now or seen, None, 0
            else:
                n = n + 1 if seen == pending else 1
                pending = seen
                if n == 2:
                    now, pending, n = seen, None, 0
                    want.append((k, i, seen))
    assert got == sorted(want)
