"""Token ids of two tokenizers aligned over the same bytes.

1. A text is read as one space and the text. The first tokenizer (byte-level BPE) gives tokens A, the second (BPE on
   pieces, which adds the space itself) tokens B; each is a range of bytes. Texts are cut before single spaces between
   other characters: no token of either tokenizer goes over such a place, so each distinct chunk is aligned once per task.
2. Tokens are the nodes of a bipartite graph, with an edge where two ranges overlap. Union-find gives its components,
   which are the least groups: they are cut where tokens of both end. Members of a component whose ranges end together are links.
3. Pairs of linked ids are counted per document, then over the corpus, by one pre-aggregated shuffle of (pair, n); the
   highest count of each B id is found among them, and each document's links are looked up.

Of two linked tokens the bytes of one end with all bytes of the other, so there are at most as many different pairs as pairs
of a token and one of its endings (`pair_bound`, some hundred thousand for these vocabularies): a bound by the vocabularies,
whatever the corpus, within which the counted pairs are broadcast.

Null and empty texts, and texts whose tokens don't spell them, have no tokens: zeros and ''. Repeated rows are counted as often
as they occur. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, small_batches

#: Distinct chunks that a task remembers before it starts anew; the result doesn't depend on it.
CACHE_CHUNKS = 250_000
CACHE_CHUNK = 64
_ROWS = 256
#: Fixed value: how the byte-level tokenizer splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Single spaces with no white space beside them.
_PLACES = re.compile(r" (?=\S)(?<=\S )")
#: Runs of white space that SPLIT's matcher would need too deep a stack for.
_WIDE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

Paths = tuple[str, str] | Callable[[], tuple[str, str]]


# ---------------------------------------------------------------- vocabularies
def byte_level_tokens(path: str) -> dict[bytes, int]:
    """Ids by bytes of a byte-level BPE file, whose letters stand for bytes."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in content.get("added_tokens", ())}
    return {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def pair_bound(first: list[bytes], second: list[bytes]) -> int:
    """How many pairs of tokens there are at most of which one's bytes end with all of the other's."""

    spelled, own = Counter(second), Counter(first)
    return sum(spelled[t[k:]] for t in first for k in range(len(t))) + sum(own[t[k:]] for t in second for k in range(1, len(t)))


# ---------------------------------------------------------------- union-find
def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to n-1 with edges (x, y): roots are united, paths shortened."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class _Grown:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self.data, self.n = np.zeros(1 << 12, np.int64), 0

    def extend(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class Aligner:
    """Aligned chunks, by number. Chunks that the tokens don't spell have no group text (None)."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken

        ranks = byte_level_tokens(byte_bpe)
        self.encoding = tiktoken.Encoding("first", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.a = {i: t for t, i in ranks.items()}
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b = [piece_bytes(p) for p in pieces]
        #: pieces that go over a space would tie chunks together
        self.chunked = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size = np.zeros(max(self.a, default=0) + 1, np.int64)
        self.a_size[list(self.a)] = [len(t) for t in self.a.values()]
        self.b_size = np.array([len(t) for t in self.b])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.links_at, self.links = (_Grown() for _ in range(6))

    def first(self, text: str) -> list[int]:
        """Ids of the first tokenizer. All but the last of a run of white space, or all at a text's end, are one piece of SPLIT."""
        if len(text) < 1000:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _WIDE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + self.encoding.encode_ordinary(text[at:])

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the chunks of each (not empty) text; of one chunk without groups where tokens don't spell the text."""
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        cut = [_PLACES.split(t) if self.chunked else [t] for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        number = self.known
        if new:
            found = dict(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self._align(new)
            number = self.known | found if any(len(c) > CACHE_CHUNK for c in new) else self.known
            self.known.update((c, k) for c, k in found.items() if len(c) <= CACHE_CHUNK)
        out = [[number[c] for c in chunks] for chunks in cut]
        for k, ids in enumerate(out):
            if len(ids) > 1 and any(self.groups[i] is None for i in ids):  # the text as a whole decides
                out[k] = [len(self.groups)]
                self._align([texts[k]])
        return out

    def _align(self, chunks: list[str]) -> None:
        a_ids, b_ids = [self.first(" " + c) for c in chunks], self.second.encode(chunks, num_threads=1)
        a_bytes, b_bytes = self.a, self.b
        good = []
        for c, a, b in zip(chunks, a_ids, b_ids, strict=True):
            body = (" " + c).encode()
            good.append(b"".join([b_bytes[i] for i in b]) == body and b"".join([a_bytes[i] for i in a]) == body)
        ok = np.array(good)
        a_n, b_n = (np.array([len(x) for x in ids]) * ok for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x for x, g in zip(ids, good, strict=True) if g), np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # an edge for each byte place where a token of either side starts: the two tokens that hold it overlap
        place = np.union1d(a_end - self.a_size[a], b_end - self.b_size[b])
        x, y = np.searchsorted(a_end, place, "right"), np.searchsorted(b_end, place, "right")
        root = components(len(a) + len(b), x, len(a) + y)
        heads, group = np.unique(root, return_inverse=True)  # the head of a group is its first A token, so groups are in order
        group_a, group_b = group[: len(a)], group[len(a) :]
        of_a, of_b = np.bincount(group_a, minlength=len(heads)), np.bincount(group_b, minlength=len(heads))
        texts_a, texts_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spelled, i, j = [], 0, 0
        for m, n in zip(of_a.tolist(), of_b.tolist(), strict=True):
            spelled.append(f"{','.join(texts_a[i : i + m])}|{','.join(texts_b[j : j + n])}" if m > 1 or n > 1 else f"{texts_a[i]}|{texts_b[j]}")
            i, j = i + m, j + n
        chunk_of_a = np.repeat(np.arange(len(chunks)), a_n)
        n_groups = np.bincount(chunk_of_a[heads], minlength=len(chunks))
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.groups += [";".join(spelled[at[k] : at[k + 1]]) if g else None for k, g in enumerate(good)]
        # members of a group that end together
        mate = np.minimum(np.searchsorted(b_end, a_end), max(len(b) - 1, 0))
        linked = np.flatnonzero((b_end[mate] == a_end) & (group_b[mate] == group_a)) if len(b) else np.zeros(0, np.int64)
        n_links = np.bincount(chunk_of_a[linked], minlength=len(chunks))
        self.links_at.extend(self.links.n + np.cumsum(n_links) - n_links)
        self.links.extend(a[linked] << 32 | b[mate[linked]])
        for column, values in ((self.n_a, a_n), (self.n_b, b_n), (self.n_groups, n_groups), (self.n_links, n_links)):
            column.extend(values)


@lru_cache(maxsize=2)
def _aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(byte_bpe, piece_bpe)


_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int32())]))
_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,m:int>>"


def _rows(aligner: Aligner, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    full = [k for k, t in enumerate(texts) if t]
    numbers = aligner.numbers([texts[k] for k in full])
    flat = np.fromiter(chain.from_iterable(numbers), np.int64)
    row = np.repeat(np.array(full, np.int64), [len(x) for x in numbers])
    sums = [np.bincount(row, c.data[flat], len(texts)).astype(np.int64) for c in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links)]
    digests = [""] * len(texts)
    groups = aligner.groups
    for k, chunks in zip(full, numbers, strict=True):
        if groups[chunks[0]] is not None:
            digests[k] = hashlib.sha256(";".join([groups[c] for c in chunks]).encode()).hexdigest()
    # links of all chunks, counted for each row
    n = aligner.n_links.data[flat]
    before = np.cumsum(n) - n
    pair = aligner.links.data[np.repeat(aligner.links_at.data[flat] - before, n) + np.arange(n.sum())]
    who = np.repeat(row, n)
    order = np.lexsort((pair, who))
    pair, who = pair[order], who[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(new)
    held = pa.StructArray.from_arrays([pa.array(pair[first]), pa.array(np.diff(np.append(first, len(pair))).astype(np.int32))], fields=list(_PAIRS.value_type))
    offsets = pa.array(np.searchsorted(who[first], np.arange(len(texts) + 1)).astype(np.int32))
    columns = [ids, *(pa.array(s) for s in sums), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, held)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def aligned(docs: DataFrame, tokenizers: Paths) -> DataFrame:
    """Counts, digest and linked pairs of ids (A id << 32 | B id, times m) of each row of docs (doc_id, text).

    tokenizers: the files of the byte-level and of the piece tokenizer on the executors, or a function that gives them there.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        aligner = _aligner(*(tokenizers() if callable(tokenizers) else tokenizers))
        for batch, texts in rows_of(batches, "text"):
            for lo in range(0, batch.num_rows, _ROWS):
                yield _rows(aligner, batch.column(0).slice(lo, _ROWS), texts.slice(lo, _ROWS).to_pylist())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of links (pair, m): how many links hold each pair, and whether no pair of its B id has more."""
    counts = materialize(links.groupBy("pair").agg(F.sum("m").alias("n")), "pairs")
    own = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(own.alias("b")).agg(F.max("n").alias("top"))
    return counts.join(top, own == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, tokenizers: Paths) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = materialize(aligned(docs, tokenizers).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = table.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.m")
    counts = materialize(pair_counts(links), "counts")
    # the vocabularies bound the number of pairs (pair_bound)
    scored = links.join(F.broadcast(counts), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    both = table.drop("pairs").join(scored.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    zero = F.lit(0).cast("long")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
