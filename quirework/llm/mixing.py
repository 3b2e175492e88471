"""Mixing sources to target shares with capped repetition.

Equal texts under several documents make sources overlap: a text's membership pattern is the number of documents that each source
has of it. Texts are aggregated by pattern; token capacity is routed from patterns to source quotas by a min-cost flow in which each
further pass over a pattern costs more (convex repetition costs). The flow's network is as large as the number of patterns,
not of texts. A source's part of a pattern is an interval on the line of passes; each text has a seeded place in a pass,
weighted by tokens, and is taken for a source as often as its places fall into the source's interval. What is taken of a text for a
source is dealt out evenly to its documents there. So no document is taken more often than its source allows, and any part of the
data can decide on its own.

A source without a target takes no part, nor do documents with a null source or text; sources without documents reach 0.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.tokens import TOKENIZER, token_count
from quirework.sources.tables import cut, spread, table

SEED = 9
#: Share of all quotas that small sources may lack at most, beside what sources without documents lack, which bounds the size of a mix.
SHORTFALL = 0.03
#: Slices in which the documents of one text are ranked.
SLICES = 64
#: Parts of a pass by which places are weighted with tokens.
BINS = 256
#: Most membership patterns, and most sources, that the driver routes.
MOST_PATTERNS = 50_000
MOST_SOURCES = 10_000


class Flow:
    """Min-cost flow: potentials by shortest paths, then all that fits along shortest paths at once, in whole tokens.

    Costs differ only between passes, so there are few lengths of paths, and as many rounds."""

    def __init__(self, nodes: int):
        self.edges: list[list[list]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> list:
        ahead = [b, capacity, cost, len(self.edges[b])]
        self.edges[a].append(ahead)
        self.edges[b].append([a, 0, -cost, len(self.edges[a]) - 1])
        return ahead

    def run(self, source: int, sink: int) -> int:
        n, sent = len(self.edges), 0
        potential = [0] * n
        while True:
            dist: list[float] = [math.inf] * n
            dist[source] = 0
            heap = [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for v, capacity, cost, _ in self.edges[u]:
                    if capacity and d + cost + potential[u] - potential[v] < dist[v]:
                        dist[v] = d + cost + potential[u] - potential[v]
                        heapq.heappush(heap, (dist[v], v))
            if math.isinf(dist[sink]):
                return sent
            for u in range(n):
                potential[u] += int(min(dist[u], dist[sink]))
            sent += self._fill(source, sink, potential)

    def _fill(self, source: int, sink: int, potential: list[int]) -> int:
        """All that fits along edges of no reduced cost, layer by layer."""
        sent = 0
        while True:
            level = [-1] * len(self.edges)
            level[source] = 0
            queue = [source]
            for u in queue:
                for v, capacity, cost, _ in self.edges[u]:
                    if capacity and level[v] < 0 and cost + potential[u] == potential[v]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[sink] < 0:
                return sent
            at = [0] * len(self.edges)
            while True:
                path: list[list] = []
                u = source
                while u != sink:
                    while at[u] < len(self.edges[u]):
                        e = self.edges[u][at[u]]
                        if e[1] and level[e[0]] == level[u] + 1 and e[2] + potential[u] == potential[e[0]]:
                            break
                        at[u] += 1
                    if at[u] < len(self.edges[u]):
                        path.append(e)
                        u = e[0]
                    elif u == source:
                        break
                    else:  # a dead end
                        level[u] = -1
                        back = path.pop()
                        u = self.edges[back[0]][back[3]][0]
                if u != sink:
                    break
                most = min(e[1] for e in path)
                for e in path:
                    e[1] -= most
                    self.edges[e[0]][e[3]][1] += most
                sent += most


def _passes(most: int) -> list[tuple[int, int]]:
    """(how many, cost) of the passes over a pattern: each one of its own cost, from 16 on ranges that double."""
    out = [(1, k * k) for k in range(min(most, 16))]
    low = 16
    while low < most:
        out.append((min(low, most - low), (low + min(low, most - low) // 2) ** 2))
        low *= 2
    return out


Pattern = tuple[dict[str, int], int]


def route(patterns: list[Pattern], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[int, str], int]:
    """Tokens from each pattern (by number) to each source. patterns: documents of a text in each source, tokens of the texts. targets: share and
    most copies of a document of each source."""
    names = sorted(targets)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    flow = Flow(sink + 1)
    most = lambda s, k: targets[s][1] * k
    for i, (members, tokens) in enumerate(patterns):
        for passes, cost in _passes(max((most(s, k) for s, k in members.items()), default=0)):
            flow.edge(0, 1 + i, tokens * passes, cost)
    kept = {(i, s): (flow.edge(1 + i, node[s], tokens * most(s, k), 0), tokens * most(s, k)) for i, (members, tokens) in enumerate(patterns) for s, k in members.items()}
    for s in names:
        flow.edge(node[s], sink, round(total * targets[s][0]), 0)
    flow.run(0, sink)
    return {at: all_ - e[1] for at, (e, all_) in kept.items() if all_ > e[1]}


def largest_total(patterns: list[Pattern], targets: dict[str, tuple[float, int]], shortfall: float = SHORTFALL) -> int:
    """The most tokens, up to those of all texts, of which the sources can't supply at most the given share of quotas, beside the quotas of
    sources without documents."""
    supply = dict.fromkeys(targets, 0)
    for members, tokens in patterns:
        for s, k in members.items():
            supply[s] += tokens * targets[s][1] * k
    everything = sum(t for _, t in patterns)

    def lacking(total: float) -> float:
        return sum(max(0.0, share - supply[s] / total) for s, (share, _) in targets.items())

    shortfall += sum(share for s, (share, _) in targets.items() if not supply[s])
    if not everything or lacking(everything) <= shortfall:
        return everything
    low, high = 1.0, float(everything)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if lacking(middle) <= shortfall else (low, middle)
    return int(low)


def mix(documents: DataFrame, sources: DataFrame, tokenizer: str = TOKENIZER, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents taken. total: tokens of the mix; largest_total if not given."""
    spark = documents.sparkSession
    rows = sources.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources")
    targets = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows}
    own = spread(documents.where("text IS NOT NULL").select("doc_id", "source", "text")).join(F.broadcast(sources.where("target_share > 0 AND max_repeats > 0").select("source")), "source")  # at most MOST_SOURCES rows
    # the filter comes after the cut: before it, it would count the tokens a second time
    held = cut(own.select("doc_id", "source", F.unhex(F.md5("text")).alias("text_key"), token_count(F.col("text"), tokenizer).alias("tokens"))).where("tokens > 0")
    by_source = held.groupBy("text_key", "source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.first("tokens").alias("tokens"))
    # a text stands in at most as many sources as there are
    member = F.struct("source", "documents", "first")
    texts = by_source.groupBy("text_key").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_list(member)).alias("members"))
    named = F.array_join(F.transform("members", lambda m: F.concat_ws("\x1e", m["source"], m["documents"].cast("string"))), "\x1f")
    texts = cut(texts.select("text_key", "tokens", "members", named.alias("pattern"), F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(1 << 40)).alias("place")))
    summed = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(summed) > MOST_PATTERNS:
        raise ValueError("too many membership patterns")
    patterns = [({m.split("\x1e")[0]: int(m.split("\x1e")[1]) for m in r["pattern"].split("\x1f")}, int(r["tokens"])) for r in summed]
    size = total if total is not None else largest_total(patterns, targets)
    flows = route(patterns, targets, size)
    # intervals on the line of passes, one source after the other
    spans, at = [], dict.fromkeys(range(len(patterns)), 0.0)
    for (i, s), f in sorted(flows.items()):
        width = f / patterns[i][1]
        spans.append((summed[i]["pattern"], s, at[i], at[i] + width))
        at[i] += width
    spans_frame = spark.createDataFrame(spans, "pattern string, source string, low double, high double")
    width = (1 << 40) // BINS
    binned = texts.withColumn("bin", F.floor(F.col("place") / width))
    bins = binned.groupBy("pattern", "bin").agg(F.sum("tokens").alias("own"))
    bins = bins.withColumn("before", F.sum("own").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("own")).withColumn("all", F.sum("own").over(Window.partitionBy("pattern")))  # BINS rows a pattern
    within = (F.col("place") - F.col("bin") * width) / width
    placed = binned.join(bins, ["pattern", "bin"]).withColumn("u", (F.col("before") + F.col("own") * within) / F.col("all"))
    taken = placed.join(spans_frame, "pattern").withColumn("copies", F.ceil(F.col("high") - F.col("u")) - F.ceil(F.col("low") - F.col("u")))
    mine = F.filter("members", lambda m: m["source"] == F.col("source"))[0]
    taken = taken.where("copies > 0").select("text_key", "source", "tokens", mine["documents"].alias("documents"), mine["first"].alias("doc_id"), F.col("copies").cast("bigint").alias("copies"))
    one = taken.where("documents = 1").select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))
    several = taken.where("documents > 1").select("text_key", "source", "copies", "documents")
    return one.unionByName(_dealt(held.join(several, ["text_key", "source"])))


def _dealt(documents: DataFrame) -> DataFrame:
    """Documents (text_key, source, doc_id, tokens, copies of the text, documents of the text) with their own copies: the first
    (copies modulo documents) have one more than the others. The documents of a text are ranked in slices, so no task gets all of them."""
    key = ["text_key", "source"]
    sliced = documents.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    sizes = sliced.groupBy(*key, "slice").agg(F.count("*").alias("n"))
    offsets = sizes.select(*key, "slice", (F.sum("n").over(Window.partitionBy(*key).orderBy("slice")) - F.col("n")).alias("offset"))  # SLICES rows a text
    ranked = sliced.withColumn("k", F.row_number().over(Window.partitionBy(*key, "slice").orderBy("doc_id"))).join(offsets, [*key, "slice"])
    own = F.floor(F.col("copies") / F.col("documents")) + F.when(F.col("offset") + F.col("k") <= F.col("copies") % F.col("documents"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "tokens", own.cast("int").alias("copies")).where("copies > 0")


def shares(taken: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, target_share, tokens, reached_share, most_copies) of each source of the mix."""
    sums = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    return (
        sources.join(sums, "source", "left")
        .withColumn("all", F.sum("tokens").over(Window.partitionBy()))  # a row for each source
        .select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    )


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "sources"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return shares(p9_mix(spark, folder), table(spark, folder, "sources"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
