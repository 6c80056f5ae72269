"""Full-text queries over documents; a document's source is its title."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.operators import ranking, search
from palimpsest.plans import model as M
from palimpsest.plans.registry import query


_stored: dict[tuple, ranking.Index] = {}


def _index(spark, d):
    """Documents, their index, and its postings and lengths.  As in an archive, the index is a stored table: written by the first query over these files, read by all until they change."""
    docs = M.table(spark, d, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"))
    key = (spark.sparkContext.applicationId, *storage.files_of(docs))
    if key not in _stored:
        _stored[key] = ranking.build(M.spread(docs), "doc_id", {"title": "title", "body": "text"})
    index = _stored[key]
    return docs, index, index.lengths


_TOKENS = """WITH t AS (SELECT doc_id, 10.0 AS w, regexp_extract_all(lower(strip_accents(source || ' ' || lang)), '[\\p{L}\\p{N}]+') AS tok FROM documents
UNION ALL SELECT doc_id, 1.0, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') FROM documents),
e AS (SELECT doc_id, w, unnest(tok) AS term FROM t), len AS (SELECT doc_id, count(*) AS dl FROM e GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(dl) AS a FROM len)"""


def _bm25(cond: str) -> str:
    return f"f AS (SELECT doc_id, sum(w) AS f FROM e WHERE {cond} GROUP BY doc_id), df AS (SELECT count(*) AS df FROM f)"


_SCORE = "(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))"


@query("bm25_single", _TOKENS + ", " + _bm25("term = 'license'") + f" SELECT doc_id, CAST(round({_SCORE} * 10000) AS BIGINT) AS score FROM f JOIN len USING (doc_id), st, df")
def bm25_single(spark, d):
    _, index, lengths = _index(spark, d)
    out = search.scored(index.postings, lengths, search.parsed("license"), "doc_id")
    return out.select("doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"))


@query("bm25_prefix", _TOKENS + ", " + _bm25("starts_with(term, 'licen')") + f" SELECT doc_id, CAST(round({_SCORE} * 10000) AS BIGINT) AS score FROM f JOIN len USING (doc_id), st, df")
def bm25_prefix(spark, d):
    _, index, lengths = _index(spark, d)
    asked = search.parsed("licen*")
    out = search.scored(ranking.expanded(index, asked), lengths, asked, "doc_id")
    return out.select("doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"))


@query("search_title", _TOKENS + ", " + _bm25("term = 'src7'") + f" SELECT doc_id, CAST(round({_SCORE} * 10000) AS BIGINT) AS score FROM f JOIN len USING (doc_id), st, df")
def search_title(spark, d):
    _, index, lengths = _index(spark, d)
    out = search.candidates(search.scored(index.postings, lengths, search.parsed("src7"), "doc_id"), "doc_id", None)
    return out.select("doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"))


_TOP = _TOKENS + """, f AS (SELECT term, doc_id, sum(w) AS f FROM e WHERE term IN ('the', 'of') GROUP BY term, doc_id), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
s AS (SELECT term, doc_id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM f JOIN df USING (term) JOIN len USING (doc_id), st)"""


@query("search_top", _TOP + " SELECT doc_id, CAST(round(sum(s) * 10000) AS BIGINT) AS score FROM s GROUP BY doc_id HAVING count(*) = 2 ORDER BY sum(s) DESC, doc_id LIMIT 100")
def search_top(spark, d):
    """The hundred best for two words, found by blocks with the highest bounds."""
    _, index, _ = _index(spark, d)
    return ranking.candidates(index, search.parsed("of the"), 100).select("doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"))


@query("search_excluding", _TOKENS + " SELECT DISTINCT doc_id FROM e WHERE term = 'license' AND doc_id NOT IN (SELECT doc_id FROM e WHERE term = 'mit')")
def search_excluding(spark, d):
    _, index, lengths = _index(spark, d)
    return search.scored(index.postings, lengths, search.parsed("license -mit"), "doc_id").select("doc_id")


_PHRASE = _TOKENS + """, p AS (SELECT doc_id, 'phrase' AS part, sum(w) AS f FROM (SELECT doc_id, w, tok, unnest(range(1, len(tok))) AS i FROM t) WHERE tok[i] = 'apache' AND tok[i + 1] = 'license' GROUP BY doc_id UNION ALL SELECT doc_id, 'word', sum(w) FROM e WHERE term = 'the' GROUP BY doc_id),
df AS (SELECT part, count(*) AS df FROM p GROUP BY part), s AS (SELECT doc_id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM p JOIN df USING (part) JOIN len USING (doc_id), st),
hits AS (SELECT doc_id, sum(s) AS score FROM s GROUP BY doc_id HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 2000)"""


@query("search_page", _PHRASE + " SELECT doc_id, CAST(round(score * 10000) AS BIGINT) AS score FROM hits JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY hits.score DESC, doc_id LIMIT 25")
def search_page(spark, d):
    """A page of hits for a phrase and a word, filtered by language after the candidate cut."""
    docs, index, _ = _index(spark, d)
    best = ranking.candidates(index, search.parsed('"apache license" the'))
    rows = best.join(docs.where(F.endswith("title", F.lit(" en"))), "doc_id").orderBy(F.desc("score"), "doc_id").limit(25)
    return rows.select("doc_id", F.round(F.col("score") * 10000).cast("long").alias("score"))


@query("search_excerpts", _TOKENS + """, h AS (SELECT DISTINCT doc_id FROM e WHERE term = 'license'), x AS (SELECT doc_id, text, strpos(lower(text), 'license') - 1 AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM h)),
w AS (SELECT *, greatest(p - 90, 0) AS a, least(p + 97, length(text)) AS b FROM x) SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '\\s+', ' ', 'g')) || CASE WHEN b < length(text) THEN '…' ELSE '' END AS snippet FROM w""")
def search_excerpts(spark, d):
    """The place of a word in each document that has it."""
    docs, index, lengths = _index(spark, d)
    asked = search.parsed("license")
    hits = search.scored(index.postings, lengths, asked, "doc_id").join(docs, "doc_id")
    return search.with_excerpts(hits, asked.terms, "text").select("doc_id", F.array_join("snippets", " | ").alias("snippet"))


@query("search_box")
def search_box(spark, d):
    """A page of hits for a phrase and a word, filtered by language after the candidate cut, with excerpts."""
    docs, index, _ = _index(spark, d)
    asked = search.parsed('"apache license" the')
    best = ranking.candidates(index, asked)
    rows = best.join(docs.where(F.endswith("title", F.lit(" en"))), "doc_id").orderBy(F.desc("score"), "doc_id").limit(25)
    return search.with_excerpts(rows.select("doc_id", "title", F.round("score", 4).alias("score"), "text"), asked.terms, "text").drop("text")


@query("index_stats", _TOKENS + " SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT term) AS terms, count(*) AS tokens FROM e")
def index_stats(spark, d):
    _, index, _ = _index(spark, d)
    return index.postings.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("term").alias("terms"), F.sum(F.size("positions")).alias("tokens"))


@query("index_vocabulary", _TOKENS + ", d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM e GROUP BY term) SELECT term, df, tf FROM d ORDER BY df DESC, term LIMIT 50")
def index_vocabulary(spark, d):
    _, index, _ = _index(spark, d)
    per = index.postings.groupBy("term", "doc_id").agg(F.sum(F.size("positions")).alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    return per.orderBy(F.desc("df"), "term").limit(50)
