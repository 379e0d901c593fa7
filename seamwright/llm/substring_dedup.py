"""Substring dedup by a log-structured fingerprint index.

The index holds fingerprints of word windows: in each window of WINDOW words the smallest hash of its
GRAM-word grams stands for it, so equal windows share their fingerprint and only a few grams of a text
are kept. Each batch of documents becomes an immutable run (fingerprint, n), bucketed and sorted by fingerprint;
runs are merge-joined with each new batch to tell what was seen before, and compacted into one
when there are more than FANOUT. With a lasting log, the documents of later calls are compared with those of earlier ones. A fingerprint seen twice only makes a window a candidate:
candidates are verified by a 128-bit hash of all their words, counted over the corpus, and windows
found twice or more lose their words in every text that holds them.

Counting is pre-aggregated and joined back by hash, so a passage in a third of all rows is a
counter, never a group of rows. No pair of documents is made.

Null or empty texts hold no window; nothing is removed from texts under WINDOW words. Equal rows hold each
other's windows. Rows without doc_id are handled like others. An empty table gives an empty result. Internal columns are prefixed,
other columns are kept.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _remove, Texts, discard, inside, materialize, rows_of, scratch_root, signed, small_batches, text_chunks, window_hashes

WINDOW, GRAM = 35, 8
#: A call's documents are appended in BATCHES batches; more than FANOUT runs are compacted.
BATCHES, FANOUT = 4, 3
#: Candidate windows are verified in so many slices of their hashes, one after the other.
SLICES = 4
KEYS = ["doc_id", "t1", "t2"]
_SPAN = WINDOW - GRAM + 1
_CHECK = 0x5851F42D4C957F2D


def _slide(x: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of `size` entries."""
    have = 1
    while 2 * have <= size:
        x = best(x[:-have], x[have:])
        have *= 2
    if have < size:
        x = best(x[: len(x) - (size - have)], x[size - have :])
    return x


def least_grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams; first words of all windows that lie in one text; the least gram hash of each of these."""
    grams = window_hashes(words, GRAM)
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return grams, none, none.view(np.uint64)
    at = np.flatnonzero(inside(first, WINDOW))
    return grams, at, _slide(grams, _SPAN, np.minimum)[at]


def selected(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of the grams that are least in some window."""
    grams, at, least = least_grams(words, first)
    if not len(at):
        return at, least
    top = np.zeros(len(grams) + _SPAN - 1, np.uint64)
    top[at + _SPAN - 1] = least
    reach = _slide(top, _SPAN, np.maximum)
    position = np.flatnonzero((reach == grams) & (reach > 0))
    return position, grams[position]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in rows_of(batches, "text"):
        for lo, hi, chunk in text_chunks(texts):
            position, hashes = selected(chunk.word_hashes(), chunk.first)
            owner = np.searchsorted(chunk.first, position, side="right") - 1
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), _lists(signed(hashes), owner, len(chunk))], [*KEYS, "prints"])


class FingerprintLog:
    """Sorted immutable runs of (print, n), as tables bucketed and sorted by print: merge joins of runs need no shuffle.

    Without a folder, runs are scratch tables of the session. With one, the log lasts: every version of its list of runs is
    a small JSON table there, and the documents of each batch (keys, prints, texts) are kept, so that windows of
    later batches can be verified against them; a log of the same folder goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.folder = spark, fanout, folder
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        self.seen: list[DataFrame] = []
        self.kept: list[str] = []
        self._paths: list[str] = []
        self.version = 0
        if folder is not None:
            try:
                last = spark.read.schema("version int, buckets int, runs array<string>, seen array<string>, kept array<string>").json(f"{folder}/versions").orderBy(F.desc("version")).first()
            except AnalysisException:  # no version has been written
                last = None
            if last is not None:
                self.version, self.buckets, self.kept, self._paths = last["version"], last["buckets"], list(last["kept"]), list(last["runs"])
                self.runs = [self._table(p) for p in last["runs"]]
                self.seen = [spark.read.schema("print long").parquet(p) for p in last["seen"]]
                for df, p in zip(self.seen, last["seen"], strict=True):
                    df._scratch_path = p

    def _table(self, path: str) -> DataFrame:
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (print BIGINT, n BIGINT) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _place(self, tag: str) -> str:
        return f"{self.folder or scratch_root(self.spark) + '/seamwright'}/{tag}-{uuid.uuid4().hex}"

    def _write(self, counted: DataFrame) -> DataFrame:
        path, name = self._place("run"), f"fingerprints_{uuid.uuid4().hex}"
        dealt = counted.repartition(self.buckets, "print")
        dealt.write.bucketBy(self.buckets, "print").sortBy("print").option("path", path).format("parquet").saveAsTable(name)
        if self.folder is None:
            atexit.register(_remove, self.spark, path)
        self._paths.append(path)
        return self.spark.table(name)

    def append(self, prints: DataFrame) -> DataFrame:
        """Add a batch (a column `print`); returns its prints that earlier runs hold, by merge joins."""
        run = self._write(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")))
        known = run.select("print").limit(0)
        if self.runs:
            path = self._place("seen")
            met = [run.select("print").join(old.select("print"), "print", "left_semi") for old in self.runs]
            reduce(DataFrame.unionByName, met).write.parquet(path)
            if self.folder is None:
                atexit.register(_remove, self.spark, path)
            seen = self.spark.read.schema("print long").parquet(path)
            seen._scratch_path = path
            self.seen.append(seen)
            known = seen.distinct()
        self.runs.append(run)
        if len(self.runs) > self.fanout:
            self.compact()
        return known

    def compact(self) -> None:
        """Merge all runs into one. In a lasting log the old runs stay, as earlier versions name them."""
        if len(self.runs) > 1:
            merged = self._entries().groupBy("print").agg(F.sum("n").alias("n"))
            old, self._paths = self._paths, []
            self.runs = [self._write(merged)]
            if self.folder is None:
                for path in old:
                    _remove(self.spark, path)

    def _entries(self) -> DataFrame:
        """(print, n) of all runs, read as plain files."""
        return self.spark.read.schema("print long, n long").parquet(*self._paths)

    def repeated(self) -> DataFrame:
        """Prints seen twice or more: in one run, or in a batch and an earlier run."""
        return reduce(DataFrame.unionByName, [self._entries().where("n > 1").select("print"), *self.seen]).distinct()

    def keep(self, held: DataFrame, texts: DataFrame) -> None:
        """Keep a call's documents (doc_id, t1, t2, prints) and their texts, and write the new version of the log."""
        path = self._place("batch")
        held.write.parquet(f"{path}/prints")
        texts.join(held.select(*[F.col(k).alias(f"k_{k}") for k in KEYS]).distinct(), F.expr("t1 = k_t1 and t2 = k_t2 and doc_id <=> k_doc_id"), "left_semi").write.parquet(f"{path}/texts")
        self.kept.append(path)
        self.version += 1
        row = [(self.version, self.buckets, self._paths, [s._scratch_path for s in self.seen], self.kept)]
        self.spark.createDataFrame(row, "version int, buckets int, runs array<string>, seen array<string>, kept array<string>").coalesce(1).write.mode("append").json(f"{self.folder}/versions")

    def history(self) -> tuple[DataFrame, DataFrame] | None:
        """(doc_id, t1, t2, prints) and (doc_id, t1, t2, text) of the documents of earlier calls."""
        if not self.kept:
            return None
        keys = "doc_id long, t1 long, t2 long"
        return tuple(self.spark.read.schema(f"{keys}, {more}").parquet(*[f"{p}/{kind}" for p in self.kept]) for kind, more in (("prints", "prints array<long>"), ("texts", "text string")))

    def drop(self) -> None:
        """Remove a log without a folder."""
        if self.folder is None:
            for path in self._paths:
                _remove(self.spark, path)
            discard(*self.seen)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifying hashes of the windows whose fingerprint is repeated. Columns: doc_id, text, t1, t2, prints."""
    kind = pa.struct([("h", pa.int64()), ("c", pa.int64())])
    for batch in batches:
        known = batch.column(4)
        for lo, hi, chunk in text_chunks(batch.column(1)):
            at = _repeated_windows(chunk, known.slice(lo, hi - lo))
            words = chunk.word_hashes()
            h, c = window_hashes(words, WINDOW), window_hashes(words, WINDOW, _CHECK)
            values = pa.StructArray.from_arrays([pa.array(signed(h[at])), pa.array(signed(c[at]))], fields=list(kind))
            owner = np.searchsorted(chunk.first, at, side="right") - 1
            offsets = pa.array(np.searchsorted(owner, np.arange(len(chunk) + 1)).astype(np.int32))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.ListArray.from_arrays(offsets, values)], [*KEYS, "windows"])


def _per_text(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, number of each value's list)."""
    flat = lists.flatten()
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))).astype(np.int64)
    return flat, np.repeat(np.arange(len(lists)), sizes)


def _repeated_windows(chunk: Texts, prints: pa.Array) -> np.ndarray:
    """First words of the windows of the chunk whose fingerprint their text's list holds."""
    words = chunk.word_hashes()
    _, at, least = least_grams(words, chunk.first)
    flat, of = _per_text(prints)
    if not len(flat) or not len(at):
        return at[:0]
    owner = np.searchsorted(chunk.first, at, side="right") - 1
    return at[_in(least, owner, flat.to_numpy().view(np.uint64), of)]


def _in(values: np.ndarray, owner: np.ndarray, held: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """For each value: does the list of its owner hold it? Exact: sorted by (value, owner)."""
    both = np.concatenate([held, values])
    who = np.concatenate([holder, owner])
    probe = np.concatenate([np.zeros(len(held), np.int8), np.ones(len(values), np.int8)])
    order = np.lexsort((probe, who, both))
    v, w, p = both[order], who[order], probe[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    start = np.flatnonzero(new)
    held_here = np.repeat(p[start] == 0, np.diff(np.append(start, len(v))))
    out = np.zeros(len(values), bool)
    mine = p == 1
    out[order[mine] - len(held)] = held_here[mine]
    return out


def _strip(schema_names: list[str], text_at: int, keep_form: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hits, copied = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
            copied = np.asarray(copied.fill_null(False), dtype=bool)
            for lo, hi, chunk in text_chunks(batch.column(text_at)):
                at = _repeated_windows(chunk, prints.slice(lo, hi - lo))
                gone = np.zeros(len(chunk.starts) + 1, np.int64)
                # a hit is the number of a candidate window of its text, in order
                flat, of = _per_text(hits.slice(lo, hi - lo))
                before = np.searchsorted(at, chunk.first[:-1])
                bad = at[before[of] + flat.to_numpy()] if len(flat) else at[:0]
                for d in np.flatnonzero(copied[lo:hi]).tolist():  # every window of a text that has a copy is repeated
                    a, b = int(chunk.first[d]), int(chunk.first[d + 1])
                    if b - a >= WINDOW:
                        bad = np.concatenate([bad, [a, b - WINDOW], np.arange(a, b - WINDOW, WINDOW)])
                np.add.at(gone, bad, 1)
                np.add.at(gone, bad + WINDOW, -1)
                removed = np.cumsum(gone[:-1]) > 0
                data, starts, ends, first = chunk.data.tobytes(), chunk.starts.tolist(), chunk.ends.tolist(), chunk.first
                kept = [b" ".join([data[starts[k] : ends[k]] for k in (np.flatnonzero(~removed[a:b]) + a).tolist()]).decode("utf-8", "replace") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                sums = np.concatenate([[0], np.cumsum(removed)])
                if keep_form:
                    whole = sums[first[1:]] == sums[first[:-1]]
                    kept = [t if same else k for t, k, same in zip(batch.column(text_at).slice(lo, hi - lo).to_pylist(), kept, whole.tolist(), strict=True)]
                columns = [batch.slice(lo, hi - lo).column(k) for k in range(len(schema_names))]
                columns[text_at] = pa.array(kept, pa.string())
                columns += [pa.array(np.diff(first).astype(np.int64)), pa.array((sums[first[1:]] - sums[first[:-1]]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*schema_names, "__sd_n_words", "__sd_n_removed"])

    return run


def remove_repeats(docs: DataFrame, batches: int = BATCHES, keep_form: bool = False, slices: int = SLICES, log: FingerprintLog | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with text made of its kept words joined by one space, and __sd_n_words, __sd_n_removed.

    keep_form: texts that lose nothing stay as they are, white space and nulls included. log: with a lasting log, windows of
    earlier calls' documents count too, and these documents join the log; what earlier calls returned stays as it is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text"), *_text_keys(text))
    keys = "doc_id long, t1 long, t2 long"
    lasting = log is not None and log.folder is not None
    log, tables = log or FingerprintLog(spark), []
    earlier = log.history()
    deal = F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches))
    for b in range(batches):
        part = materialize(texts.where(F.coalesce(deal, F.lit(0)) == b).mapInArrow(_grams, f"{keys}, prints array<long>").where("size(prints) > 0"), "prints")
        log.append(part.select(F.explode("prints").alias("print")))
        tables.append(part)
    held = own = reduce(DataFrame.unionByName, tables)
    # written apart, so that its join reads plain shuffles on both sides and a hot print's rows can be split
    repeated = materialize(log.repeated(), "repeated")
    if earlier is not None:  # documents of earlier calls that share a print with these
        fresh = own.select(F.explode("prints").alias("print")).distinct().join(repeated, "print", "left_semi")
        touched = earlier[0].select(*KEYS, F.explode("prints").alias("print")).join(fresh, "print", "left_semi").select(*[F.col(k).alias(f"k_{k}") for k in KEYS]).distinct()
        held = held.unionByName(earlier[0].join(touched, F.expr("t1 = k_t1 and t2 = k_t2 and doc_id <=> k_doc_id"), "left_semi"))
        texts = texts.unionByName(earlier[1].select(*texts.columns))

    # of equal texts one is read further; the others share its fate
    copies = held.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    first = copies.select(F.col("first").alias("doc_id"), "t1", "t2", (F.col("n") > 1).alias("copied"))
    ones = held.join(first.select(F.col("doc_id").alias("f_id"), F.col("t1").alias("f1"), F.col("t2").alias("f2")), F.expr("t1 = f1 and t2 = f2 and doc_id <=> f_id")).select(*KEYS, "prints")
    pairs = ones.select(*KEYS, F.explode("prints").alias("print"))
    known = materialize(pairs.join(repeated, "print").groupBy(*KEYS).agg(F.collect_set("print").alias("prints")), "known")
    twins = first.where("copied").select(F.col("t1").alias("f1"), F.col("t2").alias("f2"))
    copied = materialize(held.select(*KEYS).join(twins, F.expr("t1 = f1 and t2 = f2")).select(*KEYS).distinct(), "copied")
    if lasting:
        log.keep(own, docs.select(F.col("doc_id").cast("long"), text.alias("text"), *_text_keys(text)))
    discard(*tables, repeated)
    log.drop()

    asked = texts.join(known.toDF("k_id", "k1", "k2", "prints"), F.expr("t1 = k1 and t2 = k2 and doc_id <=> k_id")).select("doc_id", "text", "t1", "t2", "prints")
    windows = materialize(asked.mapInArrow(_candidates, f"{keys}, windows array<struct<h:long,c:long>>").where("size(windows) > 0"), "windows")
    flat = windows.select(*KEYS, F.posexplode("windows").alias("hit", "w")).select(*KEYS, "hit", "w.h", "w.c")
    parts = []
    for k in range(slices):  # a slice of hashes at a time bounds what lies between two stages
        mine = flat.where(F.pmod("h", F.lit(slices)) == k)
        # written apart, so that the join reads plain shuffles on both sides and a hot window's rows can be split
        twice = materialize(mine.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "c"), "twice")
        parts.append(materialize(mine.join(twice, ["h", "c"]).groupBy(*KEYS).agg(F.collect_list("hit").alias("hits")), "hits"))
        discard(twice)
    discard(windows)
    hits = reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    both = known.join(hits.toDF("h_id", "h1", "h2", "hits"), F.expr("t1 = h1 and t2 = h2 and doc_id <=> h_id")).select(*KEYS, "prints", "hits", F.lit(False).alias("copied"))
    none = F.lit(None).cast("array<long>").alias("prints"), F.lit(None).cast("array<int>").alias("hits"), F.lit(True).alias("copied")
    marks = both.unionByName(copied.select(*KEYS, *none)).groupBy(*KEYS)
    marks = marks.agg(F.first("prints", True).alias("__sd_prints"), F.first("hits", True).alias("__sd_hits"), F.max("copied").alias("__sd_copied"))

    source = docs.withColumn("text", text)
    marked = source.withColumns(dict(zip(("__sd_t1", "__sd_t2"), _text_keys(F.col("text")), strict=True)))
    named = marks.withColumnsRenamed({"doc_id": "__sd_id", "t1": "__sd_m1", "t2": "__sd_m2"})
    joined = marked.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col("__sd_id")) & F.expr("__sd_t1 = __sd_m1 and __sd_t2 = __sd_m2"), "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    out = joined.select(*[F.col(f"`{c}`") for c in source.columns], "__sd_prints", "__sd_hits", "__sd_copied")
    return out.mapInArrow(_strip(source.columns, source.columns.index("text"), keep_form), f"{fields}, __sd_n_words long, __sd_n_removed long")


def _text_keys(text: Column) -> list[Column]:
    """Two hashes of a text, together 128 bits."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]
