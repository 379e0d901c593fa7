"""Toxicity: a linear-chain CRF tags toxic words; marginals give document scores and offsets.

Labels are per document, so words of training documents are labelled first: keys (a whole word, or
its first 4, 5 or 6 letters) that hardly occur in clean documents are taken greedily while they
explain toxic documents that no earlier key explains; words with a taken key are the toxic
ones. A two-state CRF with hashed features of the word is trained on stretches of words.
Forward-backward gives each word's marginal; a document's score is the noisy-or of marginals
from LEAST_MARGINAL up, and runs of words with a marginal of at least one half are its offending spans.

A text counts as framed by clean words. Null or empty texts score 0. Repeated rows score alike.
An empty table gives an empty result; without labels of both kinds every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, materialize, rows_of, small_batches, text_chunks

#: At most so many documents of each label, those of smallest id hash, are the training sample.
TRAIN_DOCS = 800
#: At most so many stretches of words of each kind (around toxic words, around look-alikes, others), and so many of a document.
TRAIN_STRETCHES, DOC_STRETCHES = 3000, 50
KINDS = ("near", "other", "toxic")
STRETCH = 10
#: A key of toxic words is held by so many toxic sample documents and this share of them, as labels err, and by RATIO times
#: as large a share of them as of clean ones.
LEAST_DOCS, LEAST_SHARE, RATIO = 4, 0.02, 30.0
SLOTS = 1 << 18
LEAST_MARGINAL = 0.1
THRESHOLD = 0.3
#: Words of a segment, and of the overlap on either side that carries the chain across its borders.
SEGMENT, OVERLAP = 160, 24
CACHE_WORDS = 400_000
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_"


def keys_of(word: str) -> list[str]:
    w = word.lower().strip(_STRIP)
    return [f"w {w}", f"p4 {w[:4]}", f"p5 {w[:5]}", f"p6 {w[:6]}"] if w else []


def slots_of(word: str) -> list[int]:
    return [zlib.crc32(k.encode()) % SLOTS for k in keys_of(word)]


@dataclass(frozen=True)
class TokenCrf:
    """weights: of the toxic state, by feature slot (sorted slots and their weights); step[a, b] from a to b."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True))


def cover(holds: dict[str, set[int]], documents: int) -> set[str]:
    """Keys taken greedily while one explains toxic documents that none before it explains. holds: the toxic documents of each able key."""
    able, taken = dict(holds), set()
    left = set().union(*able.values()) if able else set()
    while able:
        best = max(able, key=lambda k: (len(able[k] & left), len(k), k))
        new = able.pop(best) & left
        if len(new) < max(2, LEAST_SHARE * documents / 2):
            break
        taken.add(best)
        left -= new
    return taken


def stretches_of(words: list[str], toxic: bool, taken: set[str]) -> Iterator[tuple[str, list[str], list[bool]]]:
    """(kind, words, is it a toxic one) of a document's training stretches: at most DOC_STRETCHES of a kind, evenly over the whole document."""
    even = lambda x: [x[i] for i in np.unique(np.linspace(0, len(x) - 1, min(len(x), DOC_STRETCHES)).astype(int))] if x else []
    bad = {w: not taken.isdisjoint(keys_of(w)) for w in set(words)}
    heads = {k[3:7] for k in taken if k[0] == "p"} | {k[2:6] for k in taken if k[0] == "w"}
    around = lambda i: words[max(0, i - STRETCH) : i + STRETCH + 1]
    if toxic:
        found = [("toxic", around(i)) for i in even([i for i, w in enumerate(words) if bad[w]])]
    else:
        found = [("near", around(i)) for i in even([i for i, w in enumerate(words) if w.lower().strip(_STRIP)[:4] in heads])]
        found += [("other", words[i : i + 2 * STRETCH + 1]) for i in even(list(range(0, len(words), 2 * STRETCH + 1)))]
    for kind, part in found:
        yield kind, part, [toxic and bad[w] for w in part]


def train(chosen: list[tuple[list[str], list[bool]]], rounds: int = 80, ridge: float = 2e-5) -> TokenCrf:
    """Maximum likelihood on stretches of words and their labels."""
    if not any(any(flags) for _, flags in chosen) or all(any(flags) for _, flags in chosen):
        return TokenCrf(np.zeros(0, np.int64), np.zeros(0), -40.0, np.zeros((2, 2)))
    length = 2 * STRETCH + 1
    n = len(chosen)
    features = np.full((n, length, 4), SLOTS, np.int64)
    gold = np.zeros((n, length))
    live = np.zeros((n, length), bool)
    for i, (words, bad) in enumerate(chosen):
        for j, w in enumerate(words):
            s = slots_of(w)
            features[i, j, : len(s)] = s
            gold[i, j] = bad[j]
            live[i, j] = True
    used = np.unique(features)
    at = np.searchsorted(used, features)
    blank = len(used) - 1 if used[-1] == SLOTS else -1
    k, theta = len(used), np.zeros(len(used) + 4)
    theta[k] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    prior = np.concatenate([np.zeros((n, 1)), gold], axis=1)[:, :-1]
    counts = np.zeros_like(theta)
    np.add.at(counts, at[gold > 0].ravel(), 1)
    counts[k] = gold.sum()
    counts[k + 1 :] = [((prior == a) & (gold == b) & live).sum() for a, b in ((0, 1), (1, 0), (1, 1))]
    total = float(live.sum())
    for r in range(1, rounds + 1):
        emit = np.where(live, theta[at].sum(axis=2) + theta[k], -50.0)
        step = np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]])
        a = np.zeros((n, length + 1, 2))
        a[:, 0, 1] = -1e9
        for t in range(length):
            a[:, t + 1] = np.logaddexp.reduce(a[:, t, :, None] + step, axis=1)
            a[:, t + 1, 1] += emit[:, t]
        b = np.tile(np.array([0.0, theta[k + 2]]), (n, 1))
        logz = np.logaddexp.reduce(a[:, length] + b, axis=1)
        want = np.zeros_like(theta)
        p1 = np.zeros((n, length))
        for t in range(length - 1, -1, -1):
            ahead = b + np.stack([np.zeros(n), emit[:, t]], axis=1)
            pair = np.exp(a[:, t, :, None] + step + ahead[:, None, :] - logz[:, None, None])
            p1[:, t] = pair[:, :, 1].sum(axis=1)
            s = pair[live[:, t]].sum(axis=0)
            want[k + 1 :] += [s[0, 1], s[1, 0], s[1, 1]]
            b = np.logaddexp.reduce(step + ahead[:, None, :], axis=2)
        flat = np.repeat(p1[live], 4)
        want[:k] = np.bincount(at[live].ravel(), weights=flat, minlength=k)
        want[k] = p1[live].sum()
        grad = (want - counts) / total + ridge * theta
        if blank >= 0:
            grad[blank] = 0
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.25 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    solid = np.abs(theta[:k]) > 1e-6
    if blank >= 0:
        solid[blank] = False
    return TokenCrf(used[solid], theta[:k][solid], float(theta[k]), np.array([[0.0, theta[k + 1]], [theta[k + 2], theta[k + 3]]]))


# ---------------------------------------------------------------- scoring
class Scorer:
    def __init__(self, crf: TokenCrf):
        self.crf, self.table, self.cache = crf, crf.table(), {}
        self.step = np.exp(crf.step)

    def emissions(self, texts: Texts) -> np.ndarray:
        hashes = texts.word_hashes()
        if not len(hashes):
            return np.zeros(0)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        data, cache, table, bias = texts.data.tobytes(), self.cache, self.table, self.crf.bias
        out = np.empty(len(distinct))
        for i, (h, s, e) in enumerate(zip(distinct.tolist(), texts.starts[at].tolist(), texts.ends[at].tolist(), strict=True)):
            x = cache.get(h)
            if x is None:
                x = bias + sum(table.get(k, 0.0) for k in slots_of(data[s:e].decode("utf-8", "replace")))
                cache[h] = x
            out[i] = x
        return np.exp(np.clip(out, -60, 60))[back]

    def marginals(self, texts: Texts) -> np.ndarray:
        """The probability of the toxic state at each word."""
        emit = self.emissions(texts)
        n = len(emit)
        if not n:
            return emit
        first = texts.first
        sizes = np.diff(first)
        parts = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[doc] + number * SEGMENT
        span = np.arange(-OVERLAP, SEGMENT + OVERLAP)
        at = start[:, None] + span
        ok = (at >= first[doc][:, None]) & (at < first[doc + 1][:, None])
        e = np.where(ok, emit[np.clip(at, 0, n - 1)], 0.0).T.copy()
        (a00, a01), (a10, a11) = self.step
        r, q = np.zeros(len(doc)), np.full(len(doc), a10 / a00)
        forward, width = np.empty_like(e), len(span)
        for t in range(width):
            r = e[t] * (a01 + r * a11) / (a00 + r * a10)
            forward[t] = r
        for t in range(width - 1, -1, -1):
            forward[t] *= q
            x = e[t] * q
            q = (a10 + a11 * x) / (a00 + a01 * x)
        odds = forward[OVERLAP : OVERLAP + SEGMENT].T
        inner = (np.arange(SEGMENT) + number[:, None] * SEGMENT) < sizes[doc][:, None]
        odds = odds[inner]
        return odds / (1 + odds)


SCHEMA = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>"


def toxic_scores(docs: DataFrame, crf: TokenCrf) -> DataFrame:
    """doc_id, score and spans (start and end in code points, highest marginal) of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(crf)
        for batch, texts in rows_of(batches, "text"):
            for lo, hi, chunk in text_chunks(texts):
                p = scorer.marginals(chunk)
                clean = np.log1p(-np.minimum(np.where(p >= LEAST_MARGINAL, p, 0.0), 1 - 1e-12))
                owner = chunk.owner()
                score = 1 - np.exp(np.bincount(owner, weights=clean, minlength=len(chunk)))
                spans: list[list[dict]] = [[] for _ in range(len(chunk))]
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    chars = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(bad) > 1) | (np.diff(owner[bad]) > 0)]))
                    for i, j in zip(fresh, np.append(fresh[1:], len(bad)), strict=True):
                        d = owner[bad[i]]
                        base = chars[chunk.at[d]]
                        spans[d].append({"start": int(chars[chunk.starts[bad[i]]] - base), "end": int(chars[chunk.ends[bad[j - 1]]] - base), "p": float(p[bad[i:j]].max())})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _text_words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each document. Columns: number, toxic, text."""
    for batch in batches:
        keys = [sorted({k for w in set(_text_words(t)) for k in keys_of(w)}) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.string()))], ["number", "toxic", "keys"])


def fit_token_crf(docs: DataFrame, labels: DataFrame) -> TokenCrf:
    """Train on at most TRAIN_DOCS documents of each label; labels: (doc_id, toxic), already without held-out rows.

    Of an id that recurs one text is taken. Keys are counted in Spark; what reaches the driver is which toxic sample
    documents hold an able key, and at most TRAIN_STRETCHES stretches of each kind.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64(F.lit("toxic"), "doc_id")
    picked = reduce(DataFrame.unionByName, [known.where(F.col("toxic") == t).orderBy(key, "doc_id").limit(TRAIN_DOCS) for t in (1, 0)])
    # the sample's size bounds what is broadcast; the texts stay where they are
    rows = docs.select("doc_id", F.col("text").cast("string")).where("text is not null").join(F.broadcast(picked), "doc_id")
    sample = materialize(rows.groupBy(F.col("doc_id").cast("long").alias("number"), "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return train([])
    held = materialize(sample.select("number", "toxic", "text").mapInArrow(_keys, "number long, toxic int, keys array<string>").select("number", "toxic", F.explode("keys").alias("key")), "toxic-keys")
    counts = held.groupBy("key").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    least = max(LEAST_DOCS, int(LEAST_SHARE * n_toxic))
    able = counts.where((F.col("bad") >= least) & (F.col("bad") / n_toxic > RATIO * (F.col("fine") + 0.2) / n_clean)).select("key")
    holds: dict[str, set[int]] = {}
    for r in held.where("toxic = 1").join(able, "key").select("key", "number").collect():
        holds.setdefault(r["key"], set()).add(r["number"])
    taken = cover(holds, n_toxic)
    if not taken:
        return train([])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s for toxic, text in zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True) for s in stretches_of(_text_words(text), toxic == 1, taken)]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "words", "flags"])

    found = sample.select("number", "toxic", "text").mapInArrow(stretches, "kind string, words array<string>, flags array<boolean>")
    found = materialize(found.withColumn("h", F.xxhash64("words")), "toxic-stretches")
    # each task keeps its own smallest, so no kind is ever sorted in one
    chosen = [r for kind in KINDS for r in found.where(F.col("kind") == kind).orderBy("h", "words", "flags").limit(TRAIN_STRETCHES).collect()]
    return train([(r["words"], r["flags"]) for r in chosen])
