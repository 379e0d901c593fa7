"""Spelling variants: words at one edit from each other, and the frequent form that each is a variant of.

1. Words (maximal runs of A-Z, a-z and U+00C0-U+00FF) are counted per batch, then over the corpus.
2. Near words are found by two-dimensional range reporting. For words of one length, a word's place is (rank in
   forward order, rank in the order of reversed words). The words that replace letter i of w start with w[:i], an interval of
   the first order, and end with w[i+1:], an interval of the second; those with a letter more before w[i] start with w[:i] and end with
   w[i:]. A wavelet tree over the reverse ranks, in forward order, reports the words in both.
   Deletions are insertions seen from the other word.
3. To spread this over tasks, an edit lies in the first or in the second half of the longer word, and the other half is
   intact: words meet by (length, open half, intact letters). Keys of more than GROUP rows are split again, the open part
   halved each time; with one open letter a key has at most as many words as there are letters. So no
   group grows with the corpus. Keys are dealt to buckets, and each bucket has its own orders and trees.
4. A word's form is its near word of largest n if that is ten times its own; roots follow forms by pointer jumping.

All letters have one byte in Latin-1, whose order is that of code points.

Null texts hold no words, nor do texts without runs. Rows without doc_id read as if their id were an empty string. Repeated rows
are counted as often as they occur. Words found by two places of one run of equal letters are near once. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of, small_batches, text_chunks
from .components import roots

#: Code points and occurrences that a word has at least; how many times as frequent its form is.
LETTERS, TIMES, RATIO = 7, 2, 10
#: A run is a letter short where the crc32 of id and run is a multiple of this.
SLIP = 31
#: Rows of a key beyond which it is split; rows of a bucket, about.
GROUP, BUCKET = 50_000, 200_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8, and of nothing else


# ---------------------------------------------------------------- words
def _words(least: int, slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches, "text"):
            ids = batch.column(0).to_pylist()
            for lo, hi, chunk in text_chunks(texts, lower=True):
                data, n = chunk.data, len(chunk.data)
                if n == 0:
                    continue
                lead = data == _LEAD
                letter = _LETTER[data] | lead
                letter[1:] |= lead[:-1]
                edge = np.zeros(n + 1, bool)
                edge[chunk.at] = True
                begins, ends = letter.copy(), letter.copy()
                begins[1:] &= ~letter[:-1] | edge[1:n]
                ends[:-1] &= ~letter[1:] | edge[1:n]
                start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                wide = np.concatenate([[0], np.cumsum(lead)])
                length = end - start - (wide[end] - wide[start])
                long = length >= least
                start, end, length = start[long], end[long], length[long]
                seeds = [zlib.crc32(b"%s:" % (b"" if d is None else str(d).encode())) for d in ids[lo:hi]]
                body = data.tobytes()
                runs = [body[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                owner = (np.searchsorted(chunk.at, start, side="right") - 1).tolist()
                sums = np.fromiter((zlib.crc32(w, seeds[d]) for w, d in zip(runs, owner, strict=True)), np.int64, len(runs))
                for k in np.flatnonzero(sums % slip == 0).tolist():
                    word, at = runs[k].decode(), int(sums[k] % length[k])
                    runs[k] = (word[:at] + word[at + 1 :]).encode() if length[k] > least else b""
                found = Counter(runs)
                found.pop(b"", None)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return run


def count_words(docs: DataFrame, least: int = LETTERS, times: int = TIMES, slip: int = SLIP) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of at least so many code points, found so many times."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_words(least, slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


# ---------------------------------------------------------------- range reporting
class WaveletTree:
    """A wavelet tree (as a matrix: one bit vector a level) of a permutation: which values of [low, high) stand at places [start, stop)?"""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros: list[np.ndarray] = []
        for k in reversed(range(self.levels)):
            zero = (values >> k & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values that queries report; empty branches end at once, so the work is queries and answers times levels."""
        query, prefix = np.arange(len(start)), np.zeros(len(start), np.int64)
        for depth, zeros in enumerate(self.zeros):
            k = self.levels - 1 - depth
            z0, z1, total = zeros[start], zeros[stop], zeros[-1]
            query = np.concatenate([query, query])
            start, stop = np.concatenate([z0, total + start - z0]), np.concatenate([z1, total + stop - z1])
            prefix = np.concatenate([prefix, prefix + (1 << k)])
            live = (start < stop) & (prefix < high[query]) & (prefix + (1 << k) > low[query])
            query, start, stop, prefix = query[live], start[live], stop[live], prefix[live]
        return query, prefix


def _matrix(words: np.ndarray, width: int) -> np.ndarray:
    """Latin-1 bytes of words, one row each, filled up with zeros."""
    return np.ascontiguousarray(words).view(np.uint8).reshape(len(words), width)


def _order(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows, and how many first letters each row of that order shares with the one before."""
    n, width = letters.shape
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").ravel(), kind="stable")
    sorted_ = letters[order]
    shared = np.zeros(n, np.int64)
    if n > 1:
        same = sorted_[1:] == sorted_[:-1]
        shared[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, shared


class _Intervals:
    """For rows in sorted order: places among the members of the interval of members that share so many first letters."""

    def __init__(self, letters: np.ndarray, member: np.ndarray):
        self.order, self.shared = _order(letters)
        self.before = np.concatenate([[0], np.cumsum(member[self.order])])  # members before each place
        self.rank = np.empty(len(letters), np.int64)
        self.rank[self.order] = np.arange(len(letters))

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) for each row, in its own numbering."""
        heads = self.shared < size
        heads[0] = True
        first = np.flatnonzero(heads)
        group = (np.cumsum(heads) - 1)[self.rank]
        ends = np.append(first[1:], len(heads))
        return self.before[first][group], self.before[ends][group]


def near_pairs(words: np.ndarray, member: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) pairs at one edit whose place in the longer word is from low up to high.

    words: distinct bytes of `size` letters (members), or of one letter less (not members). Members are paired both
    ways by replacement; others with members by insertion, at the first place that gives the member.
    """
    n = len(words)
    letters = _matrix(words.astype(f"S{size}"), size)
    own = np.where(member, size, size - 1)
    turned = np.zeros_like(letters)
    for length in (size, size - 1):
        rows = own == length
        turned[rows, :length] = letters[rows, :length][:, ::-1]
    forward, backward = _Intervals(letters, member), _Intervals(turned, member)
    by_forward = forward.order[member[forward.order]]  # members in forward order
    by_backward = backward.order[member[backward.order]]
    place = np.empty(n, np.int64)
    place[by_backward] = np.arange(len(by_backward))
    tree = WaveletTree(place[by_forward])
    rows_found, members_found = [], []
    for i in range(low, high):
        # replacement leaves size - 1 - i letters behind it, as does insertion in the shorter word
        start, stop = forward.of(i)
        bottom, top = backward.of(size - 1 - i)
        # a member meets itself, so it needs another one in both intervals
        least = np.where(member, 2, 1)
        asked = np.flatnonzero((stop - start >= least) & (top - bottom >= least))
        if not len(asked):
            continue
        query, value = tree.report(start[asked], stop[asked], bottom[asked], top[asked])
        row, other = asked[query], by_backward[value]
        real = row != other
        if i > 0:  # a letter inserted behind its like is counted before it
            real &= member[row] | (letters[other, i] != letters[other, i - 1])
        rows_found.append(row[real])
        members_found.append(other[real])
    if not rows_found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_found), np.concatenate(members_found)


_NEAR = "word string, n_near long, top struct<rank:long,form:string>"


def _bucket(table: pa.Table) -> pa.Table:
    """Near words of a bucket's rows (size, low, high, word, n, member), summed up by word."""
    out_words, out_counts, out_rank, out_form = [], [], [], []
    kind = np.stack([table.column(c).to_numpy() for c in ("size", "low", "high")], axis=1) if table.num_rows else np.zeros((0, 3), np.int64)
    kinds, which = np.unique(kind, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    bounds = np.searchsorted(which.ravel()[order], np.arange(len(kinds) + 1))
    words, counts, members = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("member").to_numpy()
    for k, (size, low, high) in enumerate(kinds.tolist()):
        rows = order[bounds[k] : bounds[k + 1]]
        member = members[rows].astype(bool)
        if len(rows) < 2 or not member.any():
            continue
        text = [words[r] for r in rows.tolist()]
        n = counts[rows]
        a, b = near_pairs(np.array([t.encode("latin-1") for t in text]), member, size, low, high)
        inserted = ~member[a]
        a, b = np.concatenate([a, b[inserted]]), np.concatenate([b, a[inserted]])
        if not len(a):
            continue
        # the first of each word: largest n, then smallest in code-point order
        alphabet = np.empty(len(text), np.int64)
        alphabet[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
        best = np.lexsort((alphabet[b], -n[b], a))
        a, b = a[best], b[best]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        out_words += [text[r] for r in a[first].tolist()]
        out_form += [text[r] for r in b[first].tolist()]
        out_rank.append(-n[b[first]])
        out_counts.append(np.diff(np.append(first, len(a))))
    flat = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
    top = pa.StructArray.from_arrays([flat(out_rank), pa.array(out_form, pa.string())], ["rank", "form"])
    return pa.table([pa.array(out_words, pa.string()), flat(out_counts), top], ["word", "n_near", "top"])


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, member, size, low, high) with the hash of what they have to share: the letters before low and from high on."""
    behind = F.col("high") + F.when(F.col("member"), 1).otherwise(0)  # in the shorter word, all behind the open part is one place further left
    key = F.xxhash64("size", "low", "high", F.expr("substring(word, 1, low)"), F.col("word").substr(behind, F.col("size")))
    return rows.withColumn("key", key)


def _open(rows: DataFrame, parts: list[tuple[Column, Column]]) -> DataFrame:
    """rows, once for each part [low, high) of places that is left open."""
    both = F.array(*[F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in parts])
    return rows.withColumn("part", F.explode(both)).select("word", "n", "member", "size", "part.low", "part.high")


def near_words(words: DataFrame, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, n_near, top (rank, form)) of words (word, n): how many words are near, and the first of them (rank: -n)."""
    spark = words.sparkSession
    own = words.select("word", "n", F.lit(True).alias("member"), F.length("word").alias("size"))
    shorter = words.select("word", "n", F.lit(False).alias("member"), (F.length("word") + 1).alias("size"))
    half = F.floor(F.col("size") / 2)
    left = _keyed(_open(own.unionByName(shorter), [(F.lit(0), half), (half, F.col("size"))]))
    done: list[DataFrame] = []
    while True:
        hot = left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("high") - F.col("low")).alias("open")).where((F.col("rows") > group) & (F.col("open") > 1))
        hot = materialize(hot.select(F.col("key").alias("hot")), "hot-keys")
        if hot.isEmpty():
            done.append(left)
            break
        marked = materialize(left.join(hot, F.col("key") == F.col("hot"), "left"), "marked")
        done.append(marked.where("hot is null").drop("hot"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        left = _keyed(_open(marked.where("hot is not null"), [(F.col("low"), middle), (middle, F.col("high"))]))
    rows = reduce(DataFrame.unionByName, done)
    total = 4 * words.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket))
    dealt = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).select("bucket", "size", "low", "high", "word", "n", F.col("member").cast("int").alias("member"))
    found = dealt.groupBy("bucket").applyInArrow(_bucket, _NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("top").alias("top"))


def spelling_forms(docs: DataFrame, least: int = LETTERS, times: int = TIMES, ratio: int = RATIO, slip: int = SLIP, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text)."""
    words = materialize(count_words(docs, least, times, slip), "words")
    near = near_words(words, group, bucket).withColumnRenamed("word", "of")
    form_n = -F.col("top.rank")
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    taken = form_n >= ratio * F.col("n")
    rows = joined.select("word", F.when(taken, F.col("top.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, form_n).alias("form_n"))
    rows = materialize(rows, "forms")
    discard(words)
    # forms are more frequent than what they are forms of, so they lead somewhere
    ends = roots(rows.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent")))
    last = ends.select("node", F.col("root").alias("end"))
    return rows.join(last, F.col("word") == F.col("node"), "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
