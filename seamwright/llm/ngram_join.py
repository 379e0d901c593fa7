"""N-gram Jaccard join with adaptive multi-match prefixes; links are returned as components.

A text's set holds its distinct shingles of SHINGLE words. Equal sets become one node. Tokens are ordered by an
estimate of their frequency (any order is right; rare ones first is fast), and a node of n tokens has
the prefixes of n - ceil(t n) + l tokens for l = n / 16 and n / 10 (SHARES, rounded up): two linked nodes share l
tokens of these. Each node takes the l of least estimated cost, its posting lists' lengths over l, and a pair
is a candidate if it shares min(l, l') tokens of the two prefixes. As linked sets are of like size, a node that
shares too few tokens with all others together goes before any set is read.

Posting lists are never paired off within groups of near copies. The first node of a list leads it; nodes point to
the leader they share most tokens with, and pointers end in roots. For nodes near their root
(Jaccard NEAR or more) only their differences to it are kept: nodes linked to the root are one class at
once; any further link x, y needs |Dx & Dy| >= (|Dx| + |Dy| - (|x| + |y|)(1 - t)/(1 + t)) / 2
common differences, so a prefix filter on differences, rare ones first, finds the rest exactly.
Pairs of different roots are joined by their multi-match prefixes and verified on the whole sets.

Null or empty texts have an empty set, link with nothing and are their own class. Fewer words than a shingle
make one shingle. Equal rows are one class. A null doc_id has a null class. Rows that share a doc_id are one
document: their texts are of one class. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, discard, inside, materialize, mix, rows_of, signed, small_batches, text_chunks, window_hashes
from .components import components, roots

#: The lengths of l to choose from: the set's size over these, rounded up.
SHARES = (16, 10)
#: Tokens found this often in one batch of texts (in HEAVY_AT_ONCE tokens of it, if it has more) enter the frequency estimate;
#: the most frequent HEAVY_TOKENS of them are sent to all tasks. These only shape the order of tokens.
HEAVY_IN_BATCH, HEAVY_TOKENS, HEAVY_AT_ONCE = 3, 1 << 17, 1 << 21
NEAR = 0.5


def token_sets(chunk: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text of each), by text and hash."""
    words, first = chunk.word_hashes(), chunk.first
    shingles = window_hashes(words, size)
    at = np.flatnonzero(inside(first, size))
    owner = np.searchsorted(first, at, side="right") - 1
    values = shingles[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    for n in range(1, size):  # too short for a shingle: the whole text is one
        short = np.flatnonzero(counts == n)
        if len(short):
            values = np.concatenate([values, window_hashes(words, n)[first[short]]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, owner


def _heavy(size: int):
    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= HEAVY_IN_BATCH
        return pa.RecordBatch.from_arrays([pa.array(signed(tokens[often])), pa.array(counts[often].astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for _, _, chunk in text_chunks(batch.column(0), lower=True):
                parts.append(token_sets(chunk, size)[0])
                held += len(parts[-1])
                if held >= HEAVY_AT_ONCE:
                    yield counted(parts)
                    parts, held = [], 0
            yield counted(parts)

    return run


def _prefixes(size: int, percent: int, heavy: np.ndarray, weight: np.ndarray):
    """doc_id, n, two set hashes, and the first tokens of the longest prefix in the order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            for lo, hi, chunk in text_chunks(texts, lower=True):
                values, owner = token_sets(chunk, size)
                docs = len(chunk)
                n = np.bincount(owner, minlength=docs).astype(np.int64)
                s1, s2 = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
                np.add.at(s1, owner, mix(values + np.uint64(1)))
                np.add.at(s2, owner, mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                rank = np.zeros(len(values), np.int64)
                if len(heavy):
                    k = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
                    rank = np.where(heavy[k] == values, weight[k], 0)
                order = np.lexsort((values, rank, owner))
                values, owner = values[order], owner[order]
                place = np.arange(len(values)) - (np.cumsum(n) - n)[owner]
                keep = place < (n - -(-percent * n // 100) + -(-n // SHARES[-1]))[owner]
                offsets = np.searchsorted(owner[keep], np.arange(docs + 1)).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values[keep])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), prefix], ["doc_id", "n", "s1", "s2", "prefix"])

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            for lo, hi, chunk in text_chunks(texts, lower=True):
                values, owner = token_sets(chunk, size)
                offsets = np.searchsorted(owner, np.arange(len(chunk) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))], ["node", "tokens"])

    return run


def _linked(both: Column, n: Column, m: Column, percent: int) -> Column:
    return both * 100 >= (n + m - both) * percent


def jaccard_classes(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = texts.select("text").mapInArrow(_heavy(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS).toPandas()  # bounded: it only shapes the order
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(tokens)
    run = _prefixes(size, percent, tokens[by], top["n"].to_numpy(np.int64)[by])
    whole = materialize(texts.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>"), "heads")
    heads = materialize(whole.select("doc_id", "n", "s1", "s2"), "heads")
    nodes = whole.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes, "nodes")
    discard(whole)
    ids = nodes.select("s1", "s2", "n", "node")
    out = materialize(heads.select("doc_id", "n", "s1", "s2").join(ids, ["s1", "s2", "n"], "left").select("doc_id", "n", "node"), "named")
    discard(heads)
    # rows that share a doc_id are one document, whatever their texts
    shared = out.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    same = out.join(shared, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    labels = components(_links(texts, nodes, size, percent).unionByName(same))
    discard(nodes)

    named = labels.select(F.col("node").alias("member"), "root")
    out = out.join(named, out["node"] == named["member"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node", "doc_id").alias("component_id"))


def _links(texts: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between linked nodes, enough to join every class."""
    room = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
    short, long = (F.ceil(F.col("n") / k) for k in SHARES)
    # a token's place only tells whether the shorter prefix holds it
    flat = nodes.select("node", (room + short).alias("edge"), F.posexplode("prefix").alias("at", "token")).select("token", "node", (F.col("at") < F.col("edge")).alias("early"))
    shared = flat.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("leader")).where("many > 1")
    posts = materialize(flat.join(shared, "token"), "posts")
    # the cheaper l: the posting lists read, over the tokens that a candidate must share
    sizes = nodes.select("node", "n", short.alias("short"), long.alias("long"))
    costs = posts.groupBy("node").agg(F.sum("many").alias("all"), F.sum(F.when(F.col("early"), F.col("many")).otherwise(0)).alias("some"))
    chosen = costs.join(sizes, "node").select("node", "n", F.when(F.col("some") / F.col("short") < F.col("all") / F.col("long"), F.col("short")).otherwise(F.col("long")).alias("l"), (F.col("some") / F.col("short") < F.col("all") / F.col("long")).alias("brief"))
    posts2 = posts.join(chosen, "node").where("early or not brief").select("token", "node", "n", "l", "leader")
    posts2 = materialize(_enough(posts2, percent), "prefixes")
    discard(posts)
    # what is left may have lost all its partners, or its leaders
    again = posts2.drop("leader").join(posts2.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("leader")).where("many > 1").drop("many"), "token")
    left = materialize(_enough(again, percent), "prefixes")
    discard(posts2)
    posts2 = left

    votes = posts2.where("leader <> node").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes"))
    parents = votes.groupBy("node").agg(F.min_by("leader", F.struct(-F.col("votes"), "leader")).alias("parent"))
    forest = roots(parents)

    needed = posts2.select("node").distinct()
    wanted = texts.join(needed.withColumnRenamed("node", "doc_id"), "doc_id")
    sets = materialize(wanted.mapInArrow(_whole_sets(size), "node long, tokens array<long>"), "sets")

    mine = forest.select("node", "root").join(sets, "node")
    lead = sets.select(F.col("node").alias("root"), F.col("tokens").alias("led"))
    differ = mine.join(lead, "root").select(
        "node",
        "root",
        F.size("tokens").cast("long").alias("n"),
        F.size("led").cast("long").alias("m"),
        F.concat(F.array_except("tokens", "led"), F.array_except("led", "tokens")).alias("d"),
    )
    both = (F.col("n") + F.col("m") - F.size("d")) / 2
    near = differ.where(both >= NEAR * (F.col("n") + F.col("m") - both))
    differ = materialize(near.withColumn("own", _linked(both, F.col("n"), F.col("m"), percent)), "differences")
    edges = differ.where("own").select(F.col("root").alias("a"), F.col("node").alias("b"))

    edges = edges.unionByName(_within(differ, percent)).unionByName(_across(posts2, differ, sets, percent))
    return edges


def _enough(posts: DataFrame, percent: int) -> DataFrame:
    """Posts of nodes that share tokens enough for the least l that a partner of like size can have."""
    least = F.least(F.max("l"), F.ceil(F.ceil(F.max("n") * percent / 100) / SHARES[0]))
    good = posts.groupBy("node").agg(F.count(F.lit(1)).alias("have"), least.alias("must")).where("have >= must").select("node")
    return posts.join(good, "node")


def _within(differ: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one root of which one at least isn't linked to it, by common differences."""
    c = (100 - percent) / (100 + percent)
    dx = F.size("d")
    excess = dx - (F.col("n") + F.col("m")) * c
    need = F.when(F.col("own"), F.ceil(excess / 2 + F.col("m") * c - 1e-9)).otherwise(F.ceil(excess / (1 + c) - 1e-9))
    sized = differ.select("node", "root", "n", "own", dx.alias("size"), (dx - F.greatest(F.lit(1), need) + 1).alias("length"), "d").where("length > 0")
    flat = sized.select("root", "node", "n", "own", "size", "length", F.explode("d").alias("token"))
    often = flat.groupBy("root", "token").agg(F.count(F.lit(1)).alias("many"), F.max(~F.col("own")).alias("loose"))
    ranked = flat.join(often, ["root", "token"])
    first = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("many", "token", "loose"))).alias("all"), F.first("root").alias("root"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("size").alias("size"), F.first("length").alias("length"))
    short = first.select("root", "node", "n", "own", "size", F.posexplode(F.slice("all", F.lit(1), F.col("length").cast("int"))).alias("at", "t")).where("t.many > 1 and t.loose")
    short = materialize(short.select("root", "node", "n", "own", "size", "at", F.col("t.token").alias("token")), "short")
    x = short.where("not own").select("root", "token", *[F.col(k).alias(f"x_{k}") for k in ("node", "n", "size", "at")])
    y = short.select("root", "token", *[F.col(k).alias(f"y_{k}") for k in ("node", "n", "size", "own", "at")])
    overlap = F.ceil((F.col("x_size") + F.col("y_size") - (F.col("x_n") + F.col("y_n")) * c) / 2 - 1e-9)
    fits = (F.col("x_node") != F.col("y_node")) & (F.col("y_own") | (F.col("x_node") < F.col("y_node"))) & (overlap <= F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at")))
    # places bound what two lists can share from their first common token on
    pairs = x.join(y, ["root", "token"]).where(fits).select("x_node", "y_node").distinct()
    dx_, dy_ = (differ.select(F.col("node").alias(f"{s}_node"), F.col("n").alias(f"{s}_n"), F.col("d").alias(f"{s}_d")) for s in "xy")
    checked = pairs.join(dx_, "x_node").join(dy_, "y_node")
    common = F.size(F.array_intersect("x_d", "y_d"))
    apart = F.size("x_d") + F.size("y_d") - 2 * common
    both = (F.col("x_n") + F.col("y_n") - apart) / 2
    return checked.where(_linked(both, F.col("x_n"), F.col("y_n"), percent)).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def _across(posts: DataFrame, differ: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of different roots, by their multi-match prefixes."""
    home = differ.select("node", "root")
    placed = posts.join(home, "node", "left").select("token", "node", "n", "l", F.coalesce("root", "node").alias("home"))
    mixed = placed.groupBy("token").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi").select("token")
    placed = materialize(placed.join(mixed, "token"), "placed")
    x = placed.select("token", *[F.col(k).alias(f"x_{k}") for k in ("node", "n", "l", "home")])
    y = placed.select("token", *[F.col(k).alias(f"y_{k}") for k in ("node", "n", "l", "home")])
    alike = (F.col("x_node") < F.col("y_node")) & (F.col("x_home") != F.col("y_home")) & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
    met = x.join(y, "token").where(alike).groupBy("x_node", "y_node").agg(F.count(F.lit(1)).alias("met"), F.min(F.least("x_l", "y_l")).alias("l"))
    pairs = met.where("met >= l").select("x_node", "y_node")
    sx, sy = (sets.select(F.col("node").alias(f"{s}_node"), F.col("tokens").alias(f"{s}_t")) for s in "xy")
    checked = pairs.join(sx, "x_node").join(sy, "y_node")
    both = F.size(F.array_intersect("x_t", "y_t"))
    return checked.where(_linked(both, F.size("x_t"), F.size("y_t"), percent)).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
