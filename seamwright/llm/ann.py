"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables projects vectors of length one on some Gaussian directions and cuts each projection
into three slots: one of WIDTH at a random place, and what lies on either side of it. The tuple of slots is a bucket. If a
neighbour has cosine r, its projection is normal around r times the query's, so the chance that a bucket
holds it is known; a query visits buckets in the order of that chance over the chance of any vector (its own bucket first).

How many directions, which r and how many buckets are fitted on a sample of SAMPLE vectors of each length: the fewest
buckets with which TARGET of the sample's own neighbours are found. Neighbours among all rows are nearer than those among a
sample, so recall on all rows is higher. Vectors of a length with fewer than LEAST in the sample visit every bucket.

Rows go once to the bucket of each table, queries once to each bucket that they visit, and both meet by bucket; no task
sees vectors of other buckets. A bucket of more than ROW_BLOCK rows is dealt into parts, and one visited by more than QUERY_BLOCK
queries likewise, by counts that number the buckets at most (TABLES * 3 ** 8). Each part yields its best, reranked by the
exact cosine in double precision, and the best of all parts and tables are merged.

Vectors that are null, zero, or hold null or non-finite components take no part, and those of another length
are searched among themselves. Rows with the query's vec_id are its own. Equal scores go to the smaller vec_id.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, WIDTH = 4, 1.2
#: Numbers of directions to choose from; their cost is the rows a query meets and, as PROBE_ROWS rows each, the buckets it visits.
HASHES, PROBE_ROWS = (4, 6, 8), 200
SAMPLE, SAMPLE_QUERIES, LEAST, TARGET = 4096, 256, 512, 0.95
ROW_BLOCK, QUERY_BLOCK = 4096, 1024
K = 5


@lru_cache(maxsize=16)
def _projections(size: int, hashes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and the lower edge of the middle slot, for each table."""
    rng = np.random.default_rng(97)
    return [(rng.standard_normal((size, hashes)), rng.random(hashes) * WIDTH - WIDTH) for _ in range(TABLES)]


@lru_cache(maxsize=4)
def _grid(hashes: int) -> np.ndarray:
    return np.array(list(product(range(3), repeat=hashes)))


def buckets(unit: np.ndarray, hashes: int) -> np.ndarray:
    """The bucket of each vector in each table (columns)."""
    out = np.empty((len(unit), TABLES), np.int64)
    for t, (directions, edge) in enumerate(_projections(unit.shape[1], hashes)):
        at = unit @ directions
        out[:, t] = ((at >= edge).astype(np.int64) + (at >= edge + WIDTH)) @ 3 ** np.arange(hashes)[::-1]
    return out


def _below(x: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    flat = np.array([0.5 * erfc(-v / sqrt(2)) for v in x.ravel().tolist()])
    return flat.reshape(x.shape)


def success(unit: np.ndarray, hashes: int, cosine: float) -> Iterator[np.ndarray]:
    """For each table: a row for each query with the log of each bucket's chance to hold a neighbour over that of any vector."""
    spread = sqrt(1 - cosine * cosine)
    for directions, edge in _projections(unit.shape[1], hashes):
        at = cosine * (unit @ directions)
        cuts = np.stack([edge, edge + WIDTH])
        near = _below((cuts[:, None, :] - at) / spread)
        far = _below(cuts)
        total = np.zeros((len(unit), 3**hashes))
        for j in range(hashes):
            lo, hi = near[0, :, j], near[1, :, j]
            chance = np.stack([lo, hi - lo, 1 - hi], axis=1) + 1e-12
            any_ = np.array([far[0, j], far[1, j] - far[0, j], 1 - far[1, j]])
            total += np.log(chance / any_)[:, _grid(hashes)[:, j]]
        yield total


def probes(unit: np.ndarray, fit: Fit) -> list[np.ndarray]:
    """For each table the buckets that each query visits, in order."""
    own = buckets(unit, fit.hashes)
    out = []
    for t, chance in enumerate(success(unit, fit.hashes, fit.cosine)):
        chance[np.arange(len(unit)), own[:, t]] = np.inf
        first = np.argpartition(-chance, fit.visit - 1, axis=1)[:, : fit.visit] if fit.visit < chance.shape[1] else np.tile(np.arange(chance.shape[1]), (len(unit), 1))
        order = np.argsort(-np.take_along_axis(chance, first, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(first, order, 1))
    return out


# ---------------------------------------------------------------- the fit
@dataclass(frozen=True)
class Fit:
    """Directions, the neighbours' typical cosine, and buckets to visit in each table."""

    hashes: int
    cosine: float
    visit: int


EVERY = Fit(HASHES[0], 0.5, 3 ** HASHES[0])


def fit_sample(unit: np.ndarray, rows: int, k: int = K) -> Fit:
    """The cheapest settings that find TARGET of the k nearest of a sample's vectors; rows: how many there are in all."""
    if len(unit) < LEAST:
        return EVERY
    asked = unit[:SAMPLE_QUERIES]
    close = asked @ unit.T
    close[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-close, axis=1, kind="stable")[:, :k]
    cosine = float(np.clip(np.median(np.take_along_axis(close, near, 1)[:, -1]), 0.05, 0.95))
    best: tuple[float, Fit] | None = None
    for hashes in HASHES:
        held, own = buckets(unit, hashes), buckets(asked, hashes)
        ranks, met = None, []
        for t, chance in enumerate(success(asked, hashes, cosine)):
            chance[np.arange(len(asked)), own[:, t]] = np.inf
            rank = np.empty(chance.shape, np.int32)
            np.put_along_axis(rank, np.argsort(-chance, axis=1, kind="stable"), np.arange(chance.shape[1], dtype=np.int32)[None, :], 1)
            mine = np.take_along_axis(rank, held[near, t], 1)
            ranks = mine if ranks is None else np.minimum(ranks, mine)
            met.append(rank[:, held[:, t]])
        visit = int(np.quantile(ranks, TARGET, method="higher")) + 1
        share = sum(float((m < visit).mean()) for m in met)
        cost = share * rows + PROBE_ROWS * visit * TABLES
        if best is None or cost < best[0]:
            best = (cost, Fit(hashes, cosine, visit))
    return best[1]


def fit(usable: DataFrame, k: int = K) -> dict[int, Fit]:
    """Settings by vector length, from the SAMPLE rows of smallest id hash."""
    total = usable.count()
    rows = usable.select("vec_id", "v").orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(SAMPLE).collect()
    by: defaultdict[int, list] = defaultdict(list)
    for r in rows:
        by[len(r.v)].append(r.v)
    out = {}
    for size, vectors in by.items():
        x = np.array(vectors, np.float64)
        out[size] = fit_sample(x / np.sqrt((x * x).sum(axis=1))[:, None], total * len(vectors) // len(rows), k)
    return out


# ---------------------------------------------------------------- in Spark
def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors, the same at length one) of a batch with a column v."""
    lists = batch.column(batch.schema.get_field_index("v"))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(len(at), size)
        yield size, at, x, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _counts(fits: dict[int, Fit]):
    """How many rows each bucket holds and how many queries visit it, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = np.asarray(batch.column(batch.schema.get_field_index("asks")).to_pylist(), bool)
            out: list[tuple] = []
            for size, at, _, unit in _by_length(batch):
                f = fits.get(size, EVERY)
                held = buckets(unit, f.hashes)
                asked = [p.ravel() for p in probes(unit[asks[at]], f)] if asks[at].any() else [np.zeros(0, np.int64)] * TABLES
                for t in range(TABLES):
                    rows, visits = (np.bincount(x, minlength=3**f.hashes) for x in (held[:, t], asked[t]))
                    live = np.flatnonzero(rows + visits)
                    out += zip([size] * len(live), [t] * len(live), live.tolist(), rows[live].tolist(), visits[live].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], ["size", "t", "bucket", "rows", "visits"])

    return run


def _dealt(fits: dict[int, Fit], parts: dict[tuple[int, int, int], tuple[int, int]], kind: pa.DataType):
    """Rows and queries with the key of each part in which they meet. parts: numbers of row and query parts of buckets with more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = np.asarray(batch.column(batch.schema.get_field_index("asks")).to_pylist(), bool)
            deal = np.asarray(batch.column(batch.schema.get_field_index("deal")), np.int64)
            take, keys, roles = [], [], []
            for size, at, _, unit in _by_length(batch):
                f = fits.get(size, EVERY)
                held, own = buckets(unit, f.hashes), np.flatnonzero(asks[at])
                asked = probes(unit[own], f) if len(own) else None
                for t in range(TABLES):
                    for role, index, cells in ((False, at, held[:, t : t + 1]), (True, at[own], asked[t] if asked else np.zeros((0, 1), np.int64))):
                        for i, row in zip(index.tolist(), cells.tolist(), strict=True):
                            for c in row:
                                r, q = parts.get((size, t, c), (1, 1))
                                mine, other = (q, r) if role else (r, q)
                                k = int(deal[i]) % mine
                                take += [i] * other
                                roles += [role] * other
                                keys += [f"{size} {t} {c} {j} {k}" if role else f"{size} {t} {c} {k} {j}" for j in range(other)]
            for lo in range(0, len(take), 4096):
                chosen = pa.array(take[lo : lo + 4096], pa.int64())
                columns = [pa.array(keys[lo : lo + 4096], pa.string()), pa.array(roles[lo : lo + 4096], pa.bool_())]
                columns += [batch.column(batch.schema.get_field_index(n)).take(chosen) for n in ("vec_id", "v")]
                yield pa.RecordBatch.from_arrays(columns, ["part", "asks", "vec_id", "v"])

    return run


def rerank(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> list[tuple[int, int, float]]:
    """(query, vec_id, score) of the k best rows for each query."""
    if not len(ids) or not len(query_ids):
        return []
    norm, query_norm = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    close = (queries / query_norm[:, None]) @ (rows / norm[:, None]).T
    out = []
    for q in range(len(queries)):
        own = np.flatnonzero(ids != query_ids[q])
        if not len(own):
            continue
        s = close[q, own]
        if len(s) > k:  # products of matrices differ in their last bits, so the edge is wide
            own = own[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
        exact = (rows[own] * queries[q]).sum(axis=1) / (norm[own] * query_norm[q])
        best = np.lexsort((ids[own], -exact))[:k]
        out += [(int(query_ids[q]), int(ids[own[j]]), float(exact[j])) for j in best]
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found. vectors: (vec_id, embedding); queries: which rows are queries."""
    element = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{element}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = vectors.select(F.col("vec_id").cast("long"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    fits = fit(usable, k)
    counts = usable.mapInArrow(_counts(fits), "size long, t long, bucket long, rows long, visits long").groupBy("size", "t", "bucket").agg(F.sum("rows").alias("rows"), F.sum("visits").alias("visits"))
    big = counts.where((F.col("rows") > ROW_BLOCK) | (F.col("visits") > QUERY_BLOCK)).collect()  # at most as many as there are buckets
    parts = {(r["size"], r["t"], r["bucket"]): (max(1, -(-r["rows"] // ROW_BLOCK)), max(1, -(-r["visits"] // QUERY_BLOCK))) for r in big}
    kind = pa.float32() if element == "float" else pa.float64()
    deal = F.pmod(F.xxhash64(F.lit("deal"), "vec_id"), F.lit(1 << 40))
    dealt = usable.withColumn("deal", deal).mapInArrow(_dealt(fits, parts, kind), f"part string, asks boolean, vec_id long, v array<{element}>")

    def search(table: pa.Table) -> pa.Table:
        ids, asks = table["vec_id"].to_numpy(), table["asks"].to_numpy()
        flat = np.asarray(table["v"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, asks, flat = ids[order], asks[order], flat[order]
        found = rerank(ids[~asks], flat[~asks], ids[asks], flat[asks], k)
        return pa.table([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = dealt.groupBy("part").applyInArrow(search, "query_id long, vec_id long, score double")
    # equal pairs of several tables have equal ranks; only the first k ranks of each task are shuffled
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return best.groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score")).select("query_id", "rank", "vec_id", "score")
