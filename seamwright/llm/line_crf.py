"""Quality rules: a linear-chain CRF labels each line content or boilerplate.

Lines are the \\n-split pieces that hold a word. Each gets a few binary features (length,
shares of capitals, digits, symbols, '!' and '|', share of repeated neighbours and of words in
repeated 5-word windows, an earlier equal line, place in the document). A two-state CRF is
trained on lines of labelled documents (all lines of a low-quality document count as
boilerplate); Viterbi decoding marks each line of every document, and a document stays if
content lines hold at least `least_content` of its words.

Null or empty texts have no words and fail the base rules. A document without a line that holds
a word has content share 0. Repeated rows are judged row by row, alike. An empty table gives an
empty result. Without usable labels the CRF marks everything content, so only base rules reject.
Extra columns of the input are ignored by `line_quality`.
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

from .common import Texts, mix, rows_of, small_batches, text_chunks, window_hashes, inside

#: At most so many labelled documents of each class, those of smallest id hash, train the CRF.
TRAIN_DOCS = 600
#: At most so many lines of each of them, one run at a place that a hash of its lines picks, enter training.
TRAIN_LINES = 64
LEAST_CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 5

_IS = {k: np.zeros(256, bool) for k in ("symbol", "upper", "digit", "bang", "pipe", "lead", "stop")}
_IS["symbol"][list(SYMBOLS)] = True
_IS["upper"][65:91] = True
_IS["digit"][48:58] = True
_IS["bang"][ord("!")] = True
_IS["pipe"][ord("|")] = True
_IS["lead"][:128] = True
_IS["lead"][192:] = True
_IS["stop"][list(b".!?:")] = True

#: Bucket edges of each line measure; a measure with e edges gives e + 1 binary features.
EDGES = {
    "words": (2, 4, 8, 16, 40, 100),
    "word_chars": (2.5, 4, 5.5, 7, 9),
    "upper": (0.05, 0.2, 0.5, 0.8),
    "digit": (0.01, 0.1, 0.3),
    "symbol": (0.005, 0.03, 0.1, 0.3),
    "bang": (0.01, 0.05),
    "pipe": (0.01, 0.05),
    "same": (0.01, 0.1, 0.4),
    "repeated": (0.01, 0.2, 0.6),
    "seen": (0.5,),
    "stop": (0.5,),
    "place": (0.001, 0.5, 0.999),
}
N_FEATURES = sum(len(e) + 1 for e in EDGES.values())


@dataclass(frozen=True)
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray  # a feature number for each measure of each line


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _earlier_equal(keys: np.ndarray) -> np.ndarray:
    """For each key: does an earlier entry hold the same?"""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    ranked = keys[order]
    same[order[1:]] = ranked[1:] == ranked[:-1]
    return same


def repeated_words(hashes: np.ndarray, first: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Flags of the words that lie in a window of `size` words found twice or more in their text."""
    covered = np.zeros(len(hashes), bool)
    windows = window_hashes(hashes, size)
    if not len(windows):
        return covered
    ok = np.flatnonzero(inside(first, size))
    keys = windows[ok] ^ mix(owner[ok].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    ranked, docs = keys[order], owner[ok][order]
    twin = (ranked[1:] == ranked[:-1]) & (docs[1:] == docs[:-1])
    double = np.zeros(len(keys), bool)
    double[order[1:]] |= twin
    double[order[:-1]] |= twin
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, ok[double], 1)
    np.add.at(edge, ok[double] + size, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: Texts) -> Counts:
    data, at, docs = texts.data, texts.at, len(texts)
    hashes, owner = texts.word_hashes(), texts.owner()
    is_in = {k: _sums(t[data]) for k, t in _IS.items()}
    chars_of_words = is_in["lead"][texts.ends] - is_in["lead"][texts.starts]
    char_sums = np.concatenate([[0], np.cumsum(chars_of_words)])
    repeated = repeated_words(hashes, texts.first, owner, BASE_WINDOW)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(at[:-1], breaks + 1)
    line_starts = line_starts[line_starts < len(data)] if len(data) else line_starts[:0]
    doc_of = np.searchsorted(at, line_starts, side="right") - 1
    stops = np.concatenate([line_starts[1:], [len(data)]]).astype(np.int64) if len(line_starts) else np.zeros(0, np.int64)
    ends = stops - ((stops > line_starts) & (data[np.maximum(stops - 1, 0)] == 10)) if len(stops) else stops
    w0, w1 = np.searchsorted(texts.starts, line_starts), np.searchsorted(texts.starts, ends)
    full = w1 > w0
    line_starts, ends, doc_of, w0, w1 = (x[full] for x in (line_starts, ends, doc_of, w0, w1))
    lines = texts.span_hashes(line_starts, ends) ^ mix(doc_of.astype(np.uint64) + np.uint64(1))
    seen = _earlier_equal(lines)

    per = lambda k: (is_in[k][ends] - is_in[k][line_starts]).astype(float)
    words = (w1 - w0).astype(float)
    chars = np.maximum((char_sums[w1] - char_sums[w0]).astype(float), 1)
    twins = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        twins[1:] = np.cumsum(np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]))
    covered = np.concatenate([[0], np.cumsum(repeated)])
    index = np.arange(len(doc_of)) - np.searchsorted(doc_of, doc_of) if len(doc_of) else np.zeros(0)
    n_lines = np.bincount(doc_of, minlength=docs)[doc_of] if len(doc_of) else np.zeros(0)
    values = {
        "words": words,
        "word_chars": chars / np.maximum(words, 1),
        "upper": per("upper") / chars,
        "digit": per("digit") / chars,
        "symbol": per("symbol") / chars,
        "bang": per("bang") / chars,
        "pipe": per("pipe") / chars,
        "same": (twins[w1] - twins[w0]) / np.maximum(words, 1),
        "repeated": (covered[w1] - covered[w0]) / np.maximum(words, 1),
        "seen": seen.astype(float),
        "stop": _IS["stop"][data[texts.ends[w1 - 1] - 1]].astype(float) if len(w1) else words,
        "place": index / np.maximum(n_lines - 1, 1),
    }
    features, base = np.zeros((len(words), len(EDGES)), np.int16), 0
    for k, (name, edges) in enumerate(EDGES.items()):
        features[:, k] = base + np.searchsorted(edges, values[name], side="right")
        base += len(edges) + 1
    first = texts.first
    return Counts(
        np.diff(first),
        char_sums[first[1:]] - char_sums[first[:-1]],
        is_in["symbol"][at[1:]] - is_in["symbol"][at[:-1]],
        np.bincount(doc_of[seen], minlength=docs),
        covered[first[1:]] - covered[first[:-1]],
        doc_of,
        words,
        features,
    )


# ---------------------------------------------------------------- the chain
@dataclass(frozen=True)
class LineCrf:
    """State 1 is boilerplate. emit: a weight of state 1 for each feature; step[a, b]: from a to b."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most probable state of each line; first: number of each document's first line."""
        score = self.emit[features].sum(axis=1) if len(features) else np.zeros(0)
        out = np.zeros(len(score), np.int8)
        s00, s01, s10, s11 = (float(x) for x in self.step.ravel())
        i0, i1 = (float(x) for x in self.start)
        values = score.tolist()
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b, back = i0, i1 + values[lo], []
            for x in values[lo + 1 : hi]:
                to0, to1 = b + s10 > a + s00, b + s11 > a + s01
                a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + x
                back.append((to0, to1))
            state = int(b > a)
            out[hi - 1] = state
            for k in range(hi - 2, lo - 1, -1):
                state = int(back[k - lo][state])
                out[k] = state
        return out


def train(sequences: list[tuple[np.ndarray, int]], rounds: int = 80, ridge: float = 1e-3) -> LineCrf:
    """Maximum likelihood by Adam over all sequences at once; each is (features, state of its lines)."""
    sequences = [s for s in sequences if len(s[0])]
    if len({y for _, y in sequences}) < 2:
        return LineCrf(np.zeros(N_FEATURES), np.zeros((2, 2)), np.array([0.0, -1.0]))
    sequences.sort(key=lambda s: -len(s[0]))
    n, longest = len(sequences), len(sequences[0][0])
    sizes = np.array([len(s[0]) for s in sequences])
    live = [int((sizes > t).sum()) for t in range(longest)]
    feats = [np.stack([s[0][t] for s in sequences[: live[t]]]).astype(np.int64) for t in range(longest)]
    truth = np.array([s[1] for s in sequences])
    total = float(sizes.sum())
    theta = np.zeros(N_FEATURES + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros_like(theta)
    for t in range(longest):
        y = truth[: live[t]]
        np.add.at(gold, feats[t][y == 1].ravel(), 1)
        if t:
            np.add.at(gold, N_FEATURES + 3 * y, 1)
        else:
            np.add.at(gold, N_FEATURES + 4 + y, 1)
    for k in range(1, rounds + 1):
        emit, step, start = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-2:]
        e = [np.stack([np.zeros(live[t]), emit[feats[t]].sum(axis=1)], axis=1) for t in range(longest)]
        alpha = [start + e[0]]
        for t in range(1, longest):
            alpha.append(np.logaddexp.reduce(alpha[-1][: live[t], :, None] + step, axis=1) + e[t])
        beta = np.zeros((n, 2))
        logz = np.zeros(n)
        for t in range(longest):
            last = live[t + 1] if t + 1 < longest else 0
            logz[last : live[t]] = np.logaddexp.reduce(alpha[t][last : live[t]], axis=1)
        want = np.zeros_like(theta)
        for t in range(longest - 1, -1, -1):
            c = live[t]
            p1 = np.exp(alpha[t][:c, 1] + beta[:c, 1] - logz[:c])
            np.add.at(want, feats[t].ravel(), np.repeat(p1, feats[t].shape[1]))
            if t:
                pair = alpha[t - 1][:c, :, None] + step + (e[t] + beta[:c])[:, None, :] - logz[:c, None, None]
                want[N_FEATURES : N_FEATURES + 4] += np.exp(pair).sum(axis=0).ravel()
                beta[:c] = np.logaddexp.reduce(step + (e[t] + beta[:c])[:, None, :], axis=2)
            else:
                want[-2:] += np.array([(1 - p1).sum(), p1.sum()])
        grad = (want - gold) / total + ridge * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineCrf(theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-2:])


# ---------------------------------------------------------------- in Spark
def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in rows_of(batches, "text"):
        doc_ids, quality = (batch.column(k).to_pylist() for k in (0, 2))
        for lo, _, chunk in text_chunks(texts):
            c = measure(chunk)
            first = np.searchsorted(c.line_doc, np.arange(len(chunk) + 1))
            ids, q, feats = [], [], []
            for d in range(len(chunk)):
                a, b = first[d], first[d + 1]
                if b > a:
                    start = a + zlib.crc32(c.features[a:b].tobytes()) % max(1, b - a - TRAIN_LINES + 1)
                    ids.append(doc_ids[lo + d])
                    q.append(int(quality[lo + d]))
                    feats.append(c.features[start : min(b, start + TRAIN_LINES)].ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(q, pa.int32()), pa.array(feats, pa.list_(pa.int32()))], ["doc_id", "quality", "features"])


def fit_line_crf(docs: DataFrame, labels: DataFrame) -> LineCrf:
    """Train on at most TRAIN_DOCS documents of each quality, which `labels` (doc_id, quality) gives."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    key = F.xxhash64(F.lit("line_crf"), "doc_id")
    picked = reduce(DataFrame.unionByName, [known.where(F.col("quality") == q).orderBy(key, "doc_id").limit(TRAIN_DOCS) for q in (0, 1)])
    # the sample's size bounds what is broadcast; the texts stay where they are
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    lines = texts.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(_training_lines, "doc_id long, quality int, features array<int>")
    # one text of each id, however often the id recurs: so many rows, of so many lines, are all that is collected
    rows = lines.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).collect()
    shape = len(EDGES)
    found = [(np.array(r.features, np.int16).reshape(-1, shape), 1 - r.quality) for r in rows]
    found.sort(key=lambda s: (s[1], s[0].tobytes()))
    return train(found)


def line_quality(docs: DataFrame, crf: LineCrf, least_content: float = LEAST_CONTENT) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            for lo, hi, chunk in text_chunks(texts):
                c = measure(chunk)
                first = np.searchsorted(c.line_doc, np.arange(len(chunk) + 1))
                states = crf.viterbi(c.features, first)
                content = np.bincount(c.line_doc, weights=c.line_words * (states == 0), minlength=len(chunk))
                share = content / np.maximum(c.n_words, 1)
                failed = (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)
                columns = [batch.column(0).slice(lo, hi - lo)]
                columns += [pa.array(x.astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)]
                columns += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= least_content))]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, SCHEMA)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def keep_good(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """The rows of docs that line_quality keeps, with their own columns, each judged on its own text."""
    small_batches(docs.sparkSession)
    fields = docs.schema
    at = fields.names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, chunk in text_chunks(batch.column(at)):
                c = measure(chunk)
                first = np.searchsorted(c.line_doc, np.arange(len(chunk) + 1))
                states = crf.viterbi(c.features, first)
                content = np.bincount(c.line_doc, weights=c.line_words * (states == 0), minlength=len(chunk))
                failed = (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)
                good = ~failed & (content / np.maximum(c.n_words, 1) >= LEAST_CONTENT)
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(keep, fields)
