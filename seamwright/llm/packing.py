"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

1. Each document becomes token ids and a closing id; longer ones than a sequence are cut. The pieces are
   written once as a table without texts.
2. Lengths above FILLER go to bins of GRAIN tokens, rounded up. All patterns of up to PATTERN_DOCS
   bins that fill a sequence (or miss by one or two bins) are enumerated; non-negative least
   squares fits their repeat counts to the bins' histogram; counts are rounded down.
3. What remains (rounding, and short pieces as fillers) is packed best-fit decreasing, in bulk by
   length: into the smallest gap that holds it, else into new sequences.
The plan works on counts by length (at most as many as a sequence has tokens), so its size doesn't grow
with the corpus; it maps (length, rank among the pieces of that length) to (sequence, offset).
Ranks come from counts by (length, salt), so no length is ever ordered in one task.

Null and empty texts are one closing id long. Repeated rows are packed one by one. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows_of, small_batches

SEQUENCE = 2048
CLOSING_ID = 0
GRAIN = 16
FILLER = 96
PATTERN_DOCS = 4
CACHE_PIECES = 600_000
#: Of pieces and their ids that a task remembers; a run of letters has no longest length, so their number alone bounds nothing.
CACHE_BYTES = 1 << 27
#: Pieces are a few numbers each: they are written to so many files for each core, however many partitions the texts come in.
FILES_PER_CORE = 2


# ---------------------------------------------------------------- tokens
@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class FastTokens:
    """The ids that the tokenizer in `path` gives, by its own model, piece by piece.

    Normalizing and splitting with offsets takes most of a tokenizer's time, so they are done here on whole
    texts and each distinct piece is encoded once. It serves tokenizers that lower-case, split
    by SPLIT and map bytes to letters; texts that hold a special token, or a character that this Python's Unicode tables
    don't assign (the tokenizer's may), go through the tokenizer itself.
    """

    # The split pattern and special tokens in the vocabulary file.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SPECIAL = ("<|startoftext|>", "<|endoftext|>")

    def __init__(self, path: str):
        import regex

        self.whole = _tokenizer(path)
        self.model = self.whole.model
        self.find = regex.compile(self.SPLIT).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.assigned: set[str] = set()

    def _new(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
        cost = sys.getsizeof(piece) + sys.getsizeof(out) + 100
        if cost <= CACHE_BYTES:
            if self.held + cost > CACHE_BYTES or len(self.known) >= CACHE_PIECES:
                self.known.clear()
                self.held = 0
            self.known[piece] = out
            self.held += cost
        return out

    def _all_assigned(self, text: str) -> bool:
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.assigned |= new
        return True

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens added."""
        if any(x in text for x in self.SPECIAL) or not (text.isascii() or self._all_assigned(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # the tokenizer lower-cases letter by letter, without a final sigma of its own
        text = text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])
        get, new = self.known.get, self._new
        return b"".join([get(x) or new(x) for x in self.find(text)])


@lru_cache(maxsize=2)
def fast_tokens(path: str) -> FastTokens:
    return FastTokens(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = SEQUENCE) -> DataFrame:
    """A row for each piece of docs (doc_id, text). tokenizer: a file path on the executors, or a function that gives it there."""
    small_batches(docs.sparkSession)
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_tokens(tokenizer if isinstance(tokenizer, str) else tokenizer()).encode
        for batch, column in rows_of(batches, "text"):
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 256):
                rows: list[tuple] = []
                for doc, text in zip(ids[lo : lo + 256], column.slice(lo, 256).to_pylist(), strict=True):
                    body = encode(text or "") + closing
                    for k, at in enumerate(range(0, len(body), 4 * size)):
                        part = body[at : at + 4 * size]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- the plan
def patterns(bins: int, docs: int = PATTERN_DOCS, slack: int = 2, least: int = 1) -> np.ndarray:
    """All non-decreasing tuples of up to `docs` bin numbers (0: none) whose sum is from bins - slack to bins."""
    found: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], low: int, left: int) -> None:
        if left <= slack and prefix:
            found.append(prefix + (0,) * (docs - len(prefix)))
        if len(prefix) == docs:
            return
        if len(prefix) == docs - 1:
            for x in range(max(low, left - slack), left + 1):
                found.append((*prefix, x))
            return
        for x in range(low, left + 1):
            if x == left or (left - x >= x and docs - len(prefix) > 1) or left - x <= slack:
                grow((*prefix, x), x, left - x)

    grow((), max(1, least), bins)
    return np.unique(np.array(found, np.int64).reshape(-1, docs), axis=0)


def fit_counts(parts: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - wanted|, A having a column of bin counts for each pattern; accelerated projected gradient."""
    n = len(wanted)
    flat = parts.ravel()
    scale = 1 / np.sqrt(np.maximum(wanted, 1))  # relative weight of each bin
    scale[0] = 0
    weight = scale[flat].reshape(parts.shape)
    norms = np.maximum((weight**2).sum(axis=1), 1e-12)
    target = wanted * scale
    x = np.zeros(len(parts))
    y, t = x.copy(), 1.0
    bound = 1.0
    probe = np.random.default_rng(5).random(len(parts))
    for _ in range(20):  # the largest eigenvalue of A'A by power iteration, columns scaled to norm one
        z = np.bincount(flat, (weight * (probe / np.sqrt(norms))[:, None]).ravel(), n)
        probe = (weight * z[parts]).sum(axis=1) / np.sqrt(norms)
        bound = float(np.linalg.norm(probe))
        probe /= max(bound, 1e-12)
    for _ in range(rounds):
        z = np.bincount(flat, (weight * (y / np.sqrt(norms))[:, None]).ravel(), n) - target
        grad = (weight * z[parts]).sum(axis=1) / np.sqrt(norms)
        new = np.maximum(y - grad / (1.05 * bound), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x / np.sqrt(norms)


class Plan:
    """Slots by length: (first rank, how many, first sequence, offset); sequences are numbered from 0."""

    def __init__(self, histogram: dict[int, int], size: int = SEQUENCE, grain: int = GRAIN, filler: int = FILLER):
        self.size, self.sequences = size, 0
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.left = {k: v for k, v in histogram.items() if v > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
        self.gaps: list[int] = []
        self._patterns(grain, filler)
        self._residuals()

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.slots.append((length, self.used[length], n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def _leave(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((sequence, n))

    def _patterns(self, grain: int, filler: int) -> None:
        bins = self.size // grain
        by_bin: dict[int, list[int]] = {}
        for length in sorted(self.left, reverse=True):
            if length > filler and length < self.size:
                by_bin.setdefault(-(-length // grain), []).append(length)
        if not by_bin or bins < 2:
            return
        wanted = np.zeros(bins + 1)
        for b, lengths in by_bin.items():
            wanted[b] = sum(self.left[x] for x in lengths)
        parts = patterns(bins, least=-(-filler // grain))
        parts = parts[((wanted[parts] > 0) | (parts == 0)).all(axis=1)]
        if not len(parts):
            return
        counts = np.floor(fit_counts(parts, wanted) + 1e-9).astype(np.int64)
        for k in sorted(np.flatnonzero(counts), key=lambda k: (-counts[k], k)):
            need = [int(b) for b in parts[k] if b]
            repeats = int(counts[k])
            for b in set(need):  # rounding may ask for a few more than there are
                repeats = min(repeats, sum(self.left[x] for x in by_bin[b]) // need.count(b))
            while repeats > 0:
                chosen, free = [], {}
                for b in need:  # each part takes the longest pieces that its bin still has
                    x = next(x for x in by_bin[b] if self.left[x] - free.get(x, 0) > 0)
                    free[x] = free.get(x, 0) + 1
                    chosen.append(x)
                n = min([repeats, *(self.left[x] // c for x, c in free.items())])
                offset = 0
                for x in chosen:
                    self._take(x, n, self.sequences, offset)
                    offset += x
                self._leave(self.size - offset, self.sequences, n)
                self.sequences += n
                repeats -= n

    def _residuals(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length] > 0:
                at = bisect_left(self.gaps, length)
                if at < len(self.gaps):
                    gap = self.gaps[at]
                    sequence, have = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap], self.gaps[at]
                    n = min(have, self.left[length])
                    self._take(length, n, sequence, self.size - gap)
                    self._leave(gap - length, sequence, n)
                    self._leave(gap, sequence + n, have - n)
                else:
                    copies = self.size // length
                    n, rest = divmod(self.left[length], copies)
                    for k, m in ((copies, n), (rest, 1)):
                        if k and m:
                            for j in range(k):
                                self._take(length, m, self.sequences, j * length)
                            self._leave(self.size - k * length, self.sequences, m)
                            self.sequences += m

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Slots as columns, by length and first rank."""
        return tuple(np.array(sorted(self.slots), np.int64).reshape(-1, 5).T)


# ---------------------------------------------------------------- in Spark
def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length, by counts of (length, salt)."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own)).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("base", "own", "salt")


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    files = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    pieces = materialize(pieces_of(docs, tokenizer, size).repartition(files), "pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = Plan(histogram, size).arrays()
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, offset = slots
        big = np.int64(1) << np.int64(44)
        keys = length * big + rank
        for batch in batches:
            own = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            want = own["length"].to_numpy() * big + own["rank"].to_numpy()
            k = np.searchsorted(keys, want, side="right") - 1
            columns = [own[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence[k] + (want - keys[k])), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return ranked(pieces, salts).coalesce(files).mapInArrow(place, PIECES + ", sequence_id long, offset long")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
