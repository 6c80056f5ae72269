"""Hosts, scope, audits, imports, exports, reading and upkeep on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import matching
from palimpsest.operators import audit, export, hosts, imports, reading, upkeep
from palimpsest.sources import feeds
from tests.test_operators import one


def test_roles_and_defaults(spark):
    rows = [("http://me.org/a", "link", None), ("http://me.org/a", "link", None), ("https://www.google-analytics.com/x.js", "asset", None), ("http://analytics.foo.com/", "asset", None), ("http://a.disqus.com/e", "asset", None), ("http://fonts.gstatic.com/f", "asset", None)]
    rows += [("http://x.com/share", "link", None), ("http://img.shop.net/1", "asset", None), ("http://lib.shop.net/1", "asset", None), ("http://pics.net/1", "link", "image/png"), ("http://pics.net/2", "link", "image/gif"), ("http://pics.net/3", "link", "text/html"), ("http://else.net/", "link", None), ("mailto:x", "link", None)]
    stats = hosts.statistics(spark.createDataFrame(rows, "url string, kind string, mime string"), "me.org")
    got = {r.host: (r.role, r.reason, r.fetch_assets) for r in hosts.defaults(stats, hosts_off=["lib.shop.net"], assets_on=["*.pics.net"]).collect()}
    assert got == {
        "me.org": ("self", "seed", True), "www.google-analytics.com": ("analytics", "analytics", False), "analytics.foo.com": ("analytics", "analytics", False), "a.disqus.com": ("comments", "widget", False),
        "fonts.gstatic.com": ("fonts", "assets only", True), "x.com": ("social", "widget", False), "img.shop.net": ("images", "assets only", True), "lib.shop.net": ("cdn", "preset off", False), "pics.net": ("images", "preset assets", True), "else.net": ("unknown", "review", False),
    }
    first = stats.first()
    assert first.host == "me.org" and first.link_refs == 2 and first.distinct_urls == 1 and first.samples == ["http://me.org/a"]


def test_scope(spark):
    scope = hosts.Scope(("http://a.org/",), (hosts.Rule("a.org", True), hosts.Rule("cdn.org")), ("/private",), ("bad.org",))
    scope.validate()
    rows = spark.createDataFrame([("http://a.org/x",), ("http://a.org/private/x",), ("http://cdn.org/i.png",), ("http://cdn.org/i.png?v=1",), ("http://cdn.org/page",), ("http://bad.org/i.png",), ("http://a.org/https%5C:",)], "url string")
    assert [r.why for r in scope.split_missing(rows).collect()] == ["absent", "excluded", "absent", "absent", "excluded", "excluded", "excluded"]
    assert [r.x for r in rows.select(scope.crawlable(F.col("url")).alias("x")).collect()] == [True] + [False] * 6
    for bad in (hosts.Scope((), ()), hosts.Scope(("s",), (hosts.Rule("a"), hosts.Rule("a"))), hosts.Scope(("s",), (hosts.Rule("a"),), (), ("a",)), hosts.Scope(("s",), (), ("(",))):
        with pytest.raises(ValueError):
            bad.validate()


def test_platforms(spark):
    ask = lambda g="", u="http://x.org/", p="", h="": one(spark, hosts.platform(F.col("g"), F.col("u"), F.col("p"), F.col("h")), g=g, u=u, p=p, h=h)
    assert tuple(ask(g="WordPress 6")) == ("wordpress", "strong") and tuple(ask(u="http://a.blogspot.co.uk/")) == ("blogger", "strong") and tuple(ask(u="https://en.wikipedia.org/x")) == ("mediawiki", "strong") and ask(g="bloggers") is None
    assert tuple(ask(p="WordPress.com")) == ("wordpress", "weak") and tuple(ask(h="<a href='/wp-content/x'>")) == ("wordpress", "weak") and ask() is None


def test_mangled_urls(spark):
    u = "https://blog.org/https%5C:%5C/%5C/host.net%5C/x.png"
    assert one(spark, audit.mangled(F.col("u")), u=u) and one(spark, audit.intended_host(F.col("u")), u=u) == "host.net"
    assert not one(spark, audit.mangled(F.col("u")), u="https://blog.org/5C") and one(spark, audit.intended_host(F.col("u")), u="https://blog.org/") is None
    p = one(spark, audit.projection(F.lit(0).cast("bigint"), F.lit(30), F.lit(10).cast("bigint")), u="")
    assert (p.per_minute, p.remaining, p.eta_minutes) == (0.0, 10, None)


def test_pasted_lists(spark):
    text = "see http://B.org/x#y, and (http://b.org/x) http://a.org! nothing ftp://no\nhttp://b.org:80/x?q=1."
    got = imports.listed(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("place").collect()
    assert [r.url for r in got] == ["http://b.org/x", "http://a.org/", "http://b.org:80/x?q=1"]


def test_exports(spark):
    files = spark.createDataFrame([("captures/a/x.gz",), ("captures/b/x.gz",), ("captures/c/y.gz",), ("other/a/x.gz",)], "path string")
    names = {r.path: r["name"] for r in export.unique_names(files).collect()}
    assert names == {"captures/a/x.gz": "a-x.gz", "captures/b/x.gz": "b-x.gz", "captures/c/y.gz": "y.gz", "other/a/x.gz": "2-a-x.gz"}
    records = spark.createDataFrame([("captures/a/x.gz", "u"), ("nowhere", "v")], "filename string, url string")
    with pytest.raises(Exception, match="unknown file"):
        export.retargeted(records, export.unique_names(files)).collect()
    assert export.manifest(spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")).first().hash.startswith("sha256:ba7816bf")


def test_quotes_are_found_again(spark):
    pages = spark.createDataFrame([("u", ["first and then and then", "and then second", "and then third", None])], "url string, blocks array<string>")
    notes = [(1, "u", "and then", 0, None, None), (2, "u", "and then", 9, "", " third"), (3, "u", "and then", 9, "nothing", ""), (4, "u", "gone", 0, "", ""), (5, "v", "and then", 0, "", ""), (6, "u", "and then", 9, "and then ", ""), (7, "u", "second", 1, "x", "")]
    got = reading.placed(spark.createDataFrame(notes, "id long, url string, quote string, place int, prefix string, suffix string"), pages)
    assert {r.id: (r.block, r.start, r.found) for r in got.collect()} == {1: (0, 6, True), 2: (2, 0, True), 3: (0, 6, True), 4: (-1, 0, False), 5: (-1, 0, False), 6: (0, 15, True), 7: (1, 9, True)}


def test_pages_are_compared(spark):
    schema = "url string, title string, blocks array<string>"
    x = spark.createDataFrame([("a", "A", ["one", "two"]), ("b", "B", ["one"]), ("c", "C", ["x"])], schema)
    y = spark.createDataFrame([("a", "A", ["one", "2"]), ("b", "new", ["one"]), ("d", "D", ["y"])], schema)
    assert {r.url: (r.change, r.ratio) for r in reading.compare_pages(x, y).collect()} == {"a": ("changed", 0.5), "b": ("changed", 0.0), "c": ("removed", 1.0), "d": ("added", 1.0)}


def test_sitemaps_are_walked_once(spark):
    web = {"http://a/root.xml": b"<sitemapindex><sitemap><loc>http://a/s1.xml</loc></sitemap><sitemap><loc>http://a/root.xml/</loc></sitemap></sitemapindex>", "http://a/s1.xml": b"<urlset><url><loc>http://a/1</loc></url><url><loc>http://a/1</loc><lastmod>2024</lastmod></url></urlset>"}
    bodies = spark.createDataFrame(list(web.items()), "url string, body binary")
    got = upkeep.walk_sitemaps(spark.createDataFrame([("http://a/root.xml",)], "url string"), lambda level: feeds.read_sitemaps(bodies.join(level, "url", "left_semi")))
    assert [tuple(r) for r in got.collect()] == [("http://a/1", "2024")]
    assert upkeep.walk_sitemaps(spark.createDataFrame([], "url string"), lambda level: None).count() == 0


def test_a_sitemap_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    web = [("http://a/r", "http://a/s", True), ("http://a/s", "http://p/1", False), ("http://a/s", "http://p/2", False)]
    table = spark.createDataFrame([(u, x, None, child, 0) for u, x, child in web], "url string, loc string, lastmod string, child boolean, place long")

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = upkeep.walk_sitemaps(spark.createDataFrame([("http://a/r",)], "url string"), lambda level: table.join(level, "url", "left_semi").mapInArrow(counted, table.schema), documents=None, most_urls=None)
    assert sorted(r["loc"] for r in rows.collect()) == ["http://p/1", "http://p/2"] and read.value == 3


def plain_walk(web, roots, depth, documents, most_urls):
    queue, seen, out, asked = [(u, 0) for u in sorted(roots)], set(), [], 0
    while queue and asked < documents and len(out) < most_urls:
        url, at = queue.pop(0)
        if url in seen or at > depth:
            continue
        seen.add(url)
        asked += 1
        kind, locs = web.get(url, ("urls", []))
        if kind == "urls":
            out += locs
        else:
            queue += [(u, at + 1) for u in locs]
    return set(out)


@pytest.mark.parametrize("depth, documents, most_urls", [(4, 60, 100_000), (1, 60, 100_000), (4, 7, 100_000), (4, 60, 12), (4, 9, 25), (4, 60, 1)])
def test_walks_end_at_their_bounds(spark, depth, documents, most_urls):
    web = {"http://a/r": ("index", [f"http://a/i{n}" for n in (3, 1, 2)] + ["http://a/u9"])}
    web |= {f"http://a/i{n}": ("index", [f"http://a/u{n}{m}" for m in range(4)] + ["http://a/i1", "http://a/deep"]) for n in (1, 2, 3)}
    web |= {f"http://a/u{n}{m}": ("urls", [f"http://p/{n}{m}{j}" for j in range(m + 1)]) for n in (1, 2, 3) for m in range(4)}
    web |= {"http://a/deep": ("index", ["http://a/deeper"]), "http://a/deeper": ("urls", ["http://p/deep", "http://p/110"]), "http://a/u9": ("urls", ["http://p/9"])}
    rows = [(u, loc, None, kind == "index", i) for u, (kind, locs) in web.items() for i, loc in enumerate(locs)]
    table = spark.createDataFrame(rows, "url string, loc string, lastmod string, child boolean, place long")
    got = upkeep.walk_sitemaps(spark.createDataFrame([("http://a/r",)], "url string"), lambda level: table.join(level, "url", "left_semi"), depth, documents, most_urls)
    assert {r["loc"] for r in got.collect()} == plain_walk(web, ["http://a/r"], depth, documents, most_urls)


def test_folders(spark):
    folders = spark.createDataFrame([(1, "a"), (2, "a/b"), (3, "c")], "id long, path string")
    assert sorted(r.path for r in upkeep.renamed(folders, "a", "z").collect()) == ["c", "z", "z/b"]
    with pytest.raises(ValueError):
        upkeep.renamed(folders, "a", "c")
    sites = spark.createDataFrame([(1, 2, False), (2, 2, True)], "id long, folder_id long, deleted boolean")
    why = lambda p: upkeep.deletable(folders, sites, p).first().reason
    assert (why("a"), why("a/b"), why("c")) == ("has folders", "has sites", None)
    assert upkeep.deletable(folders.where("id = 3"), sites, "c").first().reason == "last top-level folder"
    places = spark.createDataFrame([(None, 3), ("a", 7)], "parent string, sort_order int")
    assert [upkeep.next_place(places, p).first().next for p in (None, "a", "x")] == [4, 8, 1]


def test_patterns(spark):
    run = lambda u, **k: one(spark, matching.script_runs(F.col("u"), **k), u=u)
    assert run("http://a.org/x") and run("http://b.a.org/x", match=["*://*.a.org/*"]) and run("http://a.org/x", match=["http://*.a.org/*"])
    assert not run("https://a.org/x", match=["http://a.org/*"]) and not run("http://ba.org/x", match=["*://*.a.org/*"])
    assert run("http://a.org:8080/x", match=["*://a.org:8080/*"]) and not run("http://a.org/x", match=["*://a.org:8080/*"]) and run("http://a.org:9/x", match=["*://a.org/*"])
    assert run("https://a.org/p%25_q", match=["https:a.org/p%25_*"]) and not run("https://a.org/px25yq", match=["https://a.org/p%25_*"]) and not run("gopher://a/", match=["*://a/*"])
    assert not run("http://a.org/no", match=["<all_urls>"], exclude=["*/no"]) and run("http://a.org/[x]", include=["*[x]"])
    assert one(spark, matching.disallowed(F.col("p"), F.array(F.lit(""), F.lit("/s"))), p="/search") and not one(spark, matching.disallowed(F.col("p"), F.array(F.lit(""))), p="/search")
    assert one(spark, matching.comment_feed(F.col("u")), u="http://a/comments/feed") and not one(spark, matching.comment_feed(F.col("u")), u="http://a/feed")
    assert one(spark, matching.with_query(F.col("u"), "p=2"), u="http://a/?x") == "http://a/?x&p=2"


def test_names_and_reports(spark):
    assert matching.seed_text("Example.COM") == "https://example.com/" and matching.seed_text("http://a.org:81/p?q#f") == "http://a.org:81/p?q"
    for bad in ("", "ftp://a.org", "nodots"):
        with pytest.raises(ValueError):
            matching.seed_text(bad)
    assert matching.directory_text("Con" + "x" * 200) == "Con" + "x" * 93 and matching.directory_text(" ..") == ""
    assert matching.directory_text("Blogs: Ph*to  é. ") == "Blogs Ph to é" and matching.directory_text("CON.txt", "x") == "x"
    day = lambda n: datetime(2024, 1, n)
    assert matching.report_due(day(1), day(8), 7) and not matching.report_due(None, day(8), 7) and not matching.report_due(day(1), day(8), 0)
    assert matching.report_window(None, day(8), 7) == (day(1), day(8)) and matching.layered({"a": 1, "b": 1}, None, {"a": 2}) == {"a": 2, "b": 1}
    assert upkeep.report_text(spark.createDataFrame([(1, 0, 3)], "new_items int, failures int, captures int")) == ["1 new item", "3 captures"]
    states = [one(spark, matching.observed(F.col("s").cast("int"), F.lit(None).cast("string"), F.lit("http://a.org"), F.lit("http://www.a.org")), s=s) for s in ("200", "403", "410", "500", "418")]
    assert states == ["live", "blocked", "gone", "unreachable", "unreachable"]
    assert one(spark, matching.described(F.lit("gone"), F.lit(410), F.lit(None)), s="").startswith("The live site returns 410. ")


def test_owners_by_a_suffix_list(spark):
    rules = spark.createDataFrame([("com",), ("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), ("github.io",)], "rule string")
    want = {"a.b.com": "b.com", "com": "", "x.y.co.uk": "y.co.uk", "co.uk": "", "q.uk": "q.uk", "a.b.c.ck": "b.c.ck", "c.ck": "", "www.ck": "www.ck", "a.www.ck": "www.ck", "me.github.io": "me.github.io", "a.unknown": "a.unknown", "unknown": ""}
    names = spark.createDataFrame([(n,) for n in [*want, "a.b.com"]], "host string")
    got = hosts.registrable_by(names, rules).collect()
    assert len(got) == len(want) + 1 and {r.host: r.registrable for r in got} == want
