"""Mixing sources to target weights as a min-cost flow.

A document may belong to several sources.  Documents with the same set of
sources (a membership pattern) are aggregated; words flow from patterns to
source quotas.  A pattern gives its words once for nothing, a second and third
time at rising cost (convex, so fresh words go first everywhere).  The flow says
how many words each pattern gives; a seeded order of its rows, cut at one place,
says which are taken once more than the others.

The order goes by a hash of id and text; rows that are alike in both come in the
order of the scan.  The place of the cut is found digit by digit of the hash,
with sums, so that no task sees more than a small share of a pattern.  The
driver holds a row per pattern and source, nothing per document.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._scratch import keep, settled, unused

#: Words, as everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_TIMES, SEED = (1, 2, 3), 3, 20240501
#: Cost of a word's first, second, third time.
COSTS = (0, 1, 3)
#: Bits of the hash that are left after each digit.
DIGITS = (52, 40)


def capped_targets(sizes: list[float], weights: list[float], times: float = MOST_TIMES) -> list[float]:
    """Shares of the total by weight, none above ``times`` its size; what is above goes to the others by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        over = [i for i in open_ if share[i] > times * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = share[i]
            break
        for i in over:
            targets[i] = float(times * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]
    return targets


def min_cost_flow(edges: list[tuple[int, int, int, int]], n: int, source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a maximum flow of least cost.

    Primal-dual: potentials from shortest paths, then all that fits over edges
    without reduced cost, by levels.  There are as many rounds of shortest paths
    as there are different path costs, which are few.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        for x, y, k, p in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(p)
    high = [0] * n
    while True:
        dist = [None] * n
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if cap[e] > 0:
                    y, nd = to[e], d + cost[e] + high[x] - high[to[e]]
                    if dist[y] is None or nd < dist[y]:
                        dist[y] = nd
                        heapq.heappush(heap, (nd, y))
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(edges))]
        far = max(d for d in dist if d is not None)
        for x in range(n):
            high[x] += far if dist[x] is None else dist[x]
        while _pushed_by_levels(to, cap, cost, out, high, source, sink):
            pass


def _pushed_by_levels(to: list, cap: list, cost: list, out: list, high: list, source: int, sink: int) -> bool:
    """Push what fits over shortest paths (in edges) that have no reduced cost; False if there is none."""
    level = [-1] * len(out)
    level[source] = 0
    queue = deque([source])
    while queue and level[sink] < 0:
        x = queue.popleft()
        for e in out[x]:
            y = to[e]
            if level[y] < 0 and cap[e] > 0 and cost[e] + high[x] == high[y]:
                level[y] = level[x] + 1
                queue.append(y)
    if level[sink] < 0:
        return False
    untried, path, x = [0] * len(out), [], source
    while True:
        if x == sink:
            amount = min(cap[e] for e in path)
            for e in path:
                cap[e] -= amount
                cap[e ^ 1] += amount
            full = next(i for i, e in enumerate(path) if not cap[e])
            x = to[path[full] ^ 1]
            del path[full:]
            continue
        while untried[x] < len(out[x]):
            e = out[x][untried[x]]
            if cap[e] > 0 and level[to[e]] == level[x] + 1 and cost[e] + high[x] == high[to[e]]:
                path.append(e)
                x = to[e]
                break
            untried[x] += 1
        else:
            if not path:
                return True
            x = to[path.pop() ^ 1]
            untried[x] += 1


@dataclass(frozen=True)
class Plan:
    """How often the rows of ``documents`` are taken.

    ``cuts``: per pattern (JSON list of sources) whole times and, of the row up to
    which the seeded order is taken once more, hash and number (null: none).
    ``sized``: the rows by number with ``id``, ``sources``, ``pattern``, ``size`` and hash ``h``.
    """

    documents: DataFrame
    sources: Column
    id_col: str
    text_col: str
    cuts: list[tuple]
    targets: dict[str | None, tuple[int, float]]  # source -> (size, target)
    sized: DataFrame


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(id_col: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), id_col, text)


def _pattern(sources: Column) -> Column:
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(sources))), F.lit("[]"))


def _running(by: str) -> Column:
    return F.expr(f"sum(size) OVER (PARTITION BY pattern ORDER BY {by})")


def _cuts(rows: DataFrame, sums: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (``pattern``, ``rest``) the row up to which ``rest`` words are taken, to half a row: ``h`` and ``row``."""
    rows = rows.where("size > 0")
    edge = asked.withColumn("before", F.lit(0).cast("long"))
    for n, bits in enumerate(DIGITS):
        digit = F.shiftright("h", bits)
        if n:
            sums = rows.join(edge.select("pattern", "at"), (rows["pattern"] == edge["pattern"]) & (F.shiftright("h", DIGITS[n - 1]) == edge["at"])).groupBy(rows["pattern"], digit.alias("digit")).agg(F.sum("size").alias("size"))
        upto = sums.join(edge.select("pattern", "rest", "before"), "pattern").withColumn("upto", F.col("before") + _running("digit"))
        edge = upto.where("upto >= rest AND upto - size < rest").select("pattern", "rest", (F.col("upto") - F.col("size")).alias("before"), F.col("digit").alias("at"))
        edge = keep(edge, "edge")
    inside = rows.withColumn("at", F.shiftright("h", DIGITS[-1])).join(edge, ["pattern", "at"])
    alike = inside.groupBy("pattern", "rest", "before", "h").agg(F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("upto", F.col("before") + _running("h"))
    alike = alike.where("upto >= rest AND upto - size < rest").withColumn("wanted", F.expr("CAST(floor((rest - upto + size) / (size / n) + 0.5) AS LONG)"))
    alike = keep(alike.select("pattern", "h", "wanted"), "alike")
    # Rows that are alike in id and text: counted per partition of the scan, then numbered within one partition.
    part = F.shiftright("row", 33)
    same = rows.join(alike.where("wanted > 0"), ["pattern", "h"]).select("pattern", "h", "wanted", "row", part.alias("part"))
    per = same.groupBy("pattern", "h", "wanted", "part").agg(F.count("*").alias("size")).withColumn("upto", _running("part"))
    per = keep(per.where("upto >= wanted AND upto - size < wanted").select("pattern", "part", (F.col("wanted") - F.col("upto") + F.col("size")).alias("nth")), "per")
    number = F.expr("row_number() OVER (PARTITION BY pattern ORDER BY row)")
    last = same.join(per, ["pattern", "part"]).withColumn("number", number).where("number = nth").select("pattern", "row")
    return alike.join(last, "pattern", "left").select("pattern", "h", F.coalesce("row", F.lit(-1)).alias("row"))


def plan(documents: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple = WEIGHTS, times: int = MOST_TIMES) -> Plan:
    """Decide how often the rows of each pattern are taken.

    ``sources``: an array of the row's sources; null is a source like any other,
    and comes last.  Rows are taken one by one, whatever their ids, null and
    repeated ones included; a row with no source or no words is never taken.  An
    empty table gives a plan without patterns.
    """
    documents = settled(documents)
    text = F.col(text_col)
    columns = [F.col(id_col).alias("id"), sources.alias("sources"), _pattern(sources).alias("pattern"), word_count(text).alias("size"), _order(F.col(id_col), text).alias("h")]
    rows = keep(documents.select(F.monotonically_increasing_id().alias("row"), *columns), "sizes")
    sums = keep(rows.groupBy("pattern", F.shiftright("h", DIGITS[0]).alias("digit")).agg(F.sum("size").alias("size")), "sums")
    per = sums.groupBy("pattern").agg(F.sum("size").alias("size")).collect()
    patterns = sorted((r.pattern, int(r["size"])) for r in per)
    members = [json.loads(p) for p, _ in patterns]
    names = sorted({s for m in members for s in m}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for (_, n), m in zip(patterns, members, strict=True):
        for s in m:
            size[place[s]] += n
    weight = [weights[i % len(weights)] for i in range(len(names))]
    total = sum(n for _, n in patterns)
    target = capped_targets([float(x) for x in size], weight, times) if total else [0.0] * len(names)

    start, first, quota, end = 0, 1, 1 + len(patterns), 1 + len(patterns) + len(names)
    edges = []
    for i, (_, n) in enumerate(patterns):
        edges += [(start, first + i, n, COSTS[min(t, len(COSTS) - 1)] + max(0, t - len(COSTS) + 1)) for t in range(times)]
    flow_from = len(edges)
    for i, m in enumerate(members):
        edges += [(first + i, quota + place[s], times * patterns[i][1], 0) for s in m]
    edges += [(quota + j, end, round(t), 0) for j, t in enumerate(target)]
    flow = min_cost_flow(edges, end + 1, start, end)
    given = [sum(flow[i * times : (i + 1) * times]) for i in range(len(patterns))]
    assert sum(given) == sum(flow[flow_from + sum(map(len, members)) :])

    whole = {p: divmod(g, n) if n else (0, 0) for (p, n), g in zip(patterns, given, strict=True)}
    rest = [(p, r) for p, (_, r) in whole.items() if r]
    asked = documents.sparkSession.createDataFrame(rest, "pattern string, rest long")
    cuts = {r.pattern: (r.h, r.row) for r in _cuts(rows, sums, asked).collect()} if rest else {}
    return Plan(documents, sources, id_col, text_col, [(p, t, *cuts.get(p, (None, None))) for p, (t, _) in whole.items()], {s: (size[j], target[j]) for s, j in place.items()}, rows)


def _times(rows: DataFrame, decided: Plan, pattern: str, h: str, row: str, name: str) -> DataFrame:
    """``rows`` with the times taken as ``name``, by a look-up of the pattern's cut."""
    key, times, cut_h, cut_row = unused(rows, "cut_pattern", "cut_times", "cut_h", "cut_row")
    table = rows.sparkSession.createDataFrame(decided.cuts, f"{key} string, {times} long, {cut_h} long, {cut_row} long")
    if len(decided.cuts) <= 10_000:  # checked: a row a pattern
        table = F.broadcast(table)
    more = (F.col(h) < F.col(cut_h)) | ((F.col(h) == F.col(cut_h)) & (F.col(row) <= F.col(cut_row)))
    found = F.coalesce(F.col(times) + F.when(more, 1).otherwise(0), F.lit(0)).cast("long")
    return rows.join(table, rows[pattern] == table[key], "left").withColumn(name, found).drop(key, times, cut_h, cut_row)


def times_taken(decided: Plan, name: str = "times") -> DataFrame:
    """The planned documents with the number of times each row is taken, in a column ``name`` (of that name no other may exist)."""
    pattern, h, row = unused(decided.documents, "pattern", "h", "row")
    rows = decided.documents.withColumn(row, F.monotonically_increasing_id())
    rows = rows.withColumn(pattern, _pattern(decided.sources)).withColumn(h, _order(F.col(decided.id_col), F.col(decided.text_col)))
    return _times(rows, decided, pattern, h, row, name).drop(pattern, h, row)


def repeated(decided: Plan) -> DataFrame:
    """Each planned row as often as the mix takes it, with its columns."""
    times, copy = unused(decided.documents, "times", "copy")
    rows = times_taken(decided, times).where(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times, copy)


def op8(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    decided = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.array("source"))
    rows = _times(decided.sized, decided, "pattern", "h", "row", "times").select(F.col("id").cast("long").alias("doc_id"), "size", "times", F.col("sources")[0].alias("source"))
    per = spark.createDataFrame([(s, n, t) for s, (n, t) in decided.targets.items()], "s string, source_size long, target double")
    per = F.broadcast(per) if len(decided.targets) <= 10_000 else per
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")

