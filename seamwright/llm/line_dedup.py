"""Line dedup: lines that many documents hold lose all their places.

1. Texts are split at line feeds; a line's key is the line without white space (0x20, 0x09-0x0D) at both ends
   and with A-Z lower-cased. Keys are hashed to 128 bits.
2. Each text's distinct hashes are exploded and counted; hashes of LEAST documents or more are written as a table.
3. Lines are exploded again with their positions and joined with that table; what is met are positions to drop.
   They are collected by text (never by line), and the text is put together from the other lines in order.

Counts are aggregated before they are shuffled, so a line that all documents hold is a counter. The table of
common lines is joined as Spark sees fit by its size; where it has to be shuffled, rows of a hot line can be split.

A document is a doc_id: rows that share one count once for each line, rows without doc_id count one by one. Null texts read as
empty, which is one empty line; empty keys are never common. Equal rows have equal results. An empty
table gives an empty result. Other columns are kept; internal ones are prefixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rows_of, small_batches

#: Lines of so many documents go.
LEAST = 10
_WHITE = b" \t\n\v\f\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line; bytes.lower() touches A-Z only."""
    return [line.strip(_WHITE).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _hashes(distinct: bool):
    """First column and the hashes of the lines, at their positions (null where the key is empty) or each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch, texts in rows_of(batches, "text"):
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for text in texts.slice(lo, 256).to_pylist():
                    keys = line_keys(text)
                    rows.append([xxh3_128_digest(k) for k in set(keys) if k] if distinct else [xxh3_128_digest(k) if k else None for k in keys])
                part = batch.slice(lo, 256).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.binary()))], [*part.schema.names, "lines"])

    return run


def common_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(line, n): hashes of the lines that `least` or more documents of docs (doc_id, text) hold, as a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = materialize(texts.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared-ids")

    def held(part: DataFrame) -> DataFrame:
        return part.mapInArrow(_hashes(True), "doc_id long, lines array<binary>").select("doc_id", F.explode("lines").alias("line"))

    if shared.isEmpty():
        lines = held(texts).select("line")
    else:  # only rows that share an id have to be told apart by it
        once = held(texts.join(shared, "doc_id", "left_anti")).select("line")
        lines = once.unionByName(held(texts.join(shared, "doc_id", "left_semi")).distinct().select("line"))
    return materialize(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "common-lines")


def _assemble(names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                out = set(gone or ())
                kept.append("\n".join([line for k, line in enumerate(lines) if k not in out]) if out else text or "")
                n_lines.append(len(lines))
                n_dropped.append(len(out))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "__ld_n_lines", "__ld_n_dropped"])

    return run


def drop_common_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text, ...) with text made of the lines that stay, joined by line feeds, and __ld_n_lines, __ld_n_dropped."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    own = [F.col("doc_id").cast("long"), F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    common = common_lines(docs, least)
    keys = ["k_id", "k1", "k2"]
    lines = docs.select(*[c.alias(k) for c, k in zip(own, keys, strict=True)], text.alias("text")).mapInArrow(_hashes(False), "k_id long, k1 long, k2 long, lines array<binary>")
    met = lines.select(*keys, F.posexplode("lines").alias("position", "line")).where("line is not null").join(common.select("line"), "line")
    gone = materialize(met.groupBy(*keys).agg(F.collect_set("position").alias("gone")), "lines-to-drop")
    discard(common)
    source = docs.withColumn("text", text)
    marked = source.withColumns({"__ld_1": own[1], "__ld_2": own[2]}).join(gone.withColumnsRenamed({k: f"__ld_{k}" for k in [*keys, "gone"]}), own[0].eqNullSafe(F.col("__ld_k_id")) & F.expr("__ld_1 = __ld_k1 and __ld_2 = __ld_k2"), "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    out = marked.select(*[F.col(f"`{c}`") for c in source.columns], "__ld_gone")
    return out.mapInArrow(_assemble(source.columns, source.columns.index("text")), f"{fields}, __ld_n_lines long, __ld_n_dropped long")
