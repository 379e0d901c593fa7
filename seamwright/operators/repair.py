"""Repairs and receipts (M1-M8): text edits of client files, and the verdict after checking again.

Edits work on the scanner's tokens of a file and are applied from right to left. A patched file is just another row of
the files table, so a receipt is the check of the patched table against the same server.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import dealt
from ..sources.ts_source import Source

LEAST_CONFIDENCE = 70
#: Kinds of intent that can be repaired.
REPAIRABLE = ("rename-field", "widen-optionality")


def _apply(text: str, edits: list[tuple[int, int, str]]) -> str:
    for at, end, new in sorted(set(edits), reverse=True):
        text = text[:at] + new + text[end:]
    return text


def _is_target(s: Source, k: int) -> bool:
    """Is the property that ends at k written to?"""
    return s.is_(k + 1, "=") and not s.is_(k + 2, "=") and not s.is_(k + 2, ">")


def rename_in_source(text: str, old: str, new: str) -> str:
    """M1, M3: reads of `.old`, `["old"]` and names taken apart become new; assignments stay."""
    s, edits = Source(text), []
    for k, t in enumerate(s.tokens):
        if t.kind == "name" and t.text == old and (s.is_(k - 1, ".") or s.is_(k - 1, "?.")) and not _is_target(s, k):
            edits.append((t.at, t.at + len(old), new))
        elif t.kind == "string" and t.text[1:-1] == old and s.is_(k - 1, "[") and s.is_(k + 1, "]") and not _is_target(s, k + 1):
            edits.append((t.at + 1, t.at + 1 + len(old), new))
    for k, t in enumerate(s.tokens):
        if t.text in ("const", "let", "var") and s.is_(k + 1, "{") and k + 1 in s.match:
            for a, _ in s.arguments(k + 1):
                x = s.tokens[a]
                if x.kind == "name" and x.text == old:
                    edits.append((x.at, x.at + len(old), new if s.is_(a + 1, ":") else f"{new}: {old}"))
    return _apply(text, edits)


def optional_chain_in_source(text: str, name: str) -> str:
    """M2, M4: what follows a read of `.name` (another property, an index, a call) becomes optional."""
    s, edits = Source(text), []
    for k, t in enumerate(s.tokens):
        if t.kind == "name" and t.text == name and (s.is_(k - 1, ".") or s.is_(k - 1, "?.")):
            after = s.tokens[k + 1]
            if after.text == ".":
                edits.append((after.at, after.at + 1, "?."))
            elif after.text in "[(" and after.kind == "mark":
                edits.append((after.at, after.at, "?."))
    return _apply(text, edits)


TRANSFORMS: dict[str, Callable[[str, str, str], str]] = {"rename-field": rename_in_source, "widen-optionality": lambda text, old, _: optional_chain_in_source(text, old)}


def repair_files(files: DataFrame, impacts: DataFrame, kind: str, old: str, new: str = "") -> DataFrame:
    """M5, M6: snapshot, path, lang, text, status of every file: patched, unchanged, or why it was skipped.

    impacts: path, severity, field_level_match, confidence, ord. The first BREAKING impact of a file decides.
    """
    if kind not in TRANSFORMS:
        raise ValueError(f"no repair for {kind}")
    first = impacts.where("severity = 'BREAKING'").withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where("k = 1")
    able = F.col("field_level_match") & (F.col("confidence") >= LEAST_CONFIDENCE)
    judged = first.select(F.col("path").alias("p"), able.alias("able"))
    rows = files.join(judged, files["path"] == judged["p"], "left").select("snapshot", "path", "lang", "text", "able")
    edit = TRANSFORMS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, status = [], []
            for text, ok in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                out = edit(text, old, new) if ok and text is not None else text
                texts.append(out)
                status.append(None if ok is None else "skipped: not certain enough" if not ok else "patched" if out != text else "skipped: nothing to edit")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array(status, pa.string())], ["snapshot", "path", "lang", "text", "status"])

    return dealt(rows).mapInArrow(run, "snapshot string, path string, lang string, text string, status string")


def repair_versions(files: DataFrame, impacts: DataFrame) -> DataFrame:
    """M5, M6 for many intents: folder, path, lang, text, status of each file that an intent's first BREAKING impact there names.

    impacts: folder (of the intent), path, severity, field_level_match, confidence, ord, and the intent's kind, old and new.
    """
    order = F.struct("ord", "field_level_match", "confidence", "kind", "old", "new")
    first = impacts.where("severity = 'BREAKING'").groupBy("folder", "path").agg(F.min(order).alias("x"))
    able = F.col("x.field_level_match") & (F.col("x.confidence") >= LEAST_CONFIDENCE)
    judged = first.select("folder", F.col("path").alias("p"), able.alias("able"), "x.kind", "x.old", "x.new")
    rows = files.join(judged, F.col("path") == F.col("p")).select("folder", "path", "lang", "text", "able", "kind", "old", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, status = [], []
            for text, able, kind, old, new in zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True):
                out = TRANSFORMS[kind](text, old, new) if able and text is not None and kind in TRANSFORMS else text
                texts.append(out)
                status.append("skipped: not certain enough" if not able else "patched" if out != text else "skipped: nothing to edit")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array(status, pa.string())], ["folder", "path", "lang", "text", "status"])

    return dealt(rows).mapInArrow(run, "folder string, path string, lang string, text string, status string")


def receipt_verdict(has_intent: Column, repairable: Column, before: Column, after: Column, breaking: Column, unknown: Column, new_breaking: Column, still_breaking: Column, patched: Column) -> Column:
    """M7, M8. before and after: the intent's verdict without and with the patches; breaking and unknown: counts of all impacts before."""
    complete = before == "COMPLETE"
    return (
        F.when(~has_intent, F.when(breaking > 0, "FAIL").when(unknown > 0, "REVIEW_REQUIRED").otherwise("PASS"))
        .when(~repairable, F.when(complete, "PASS").otherwise("REVIEW_REQUIRED"))
        .when(patched == 0, F.when(complete, "PASS").otherwise("FAIL"))
        .when((before == "UNVERIFIED") | (new_breaking > 0) | (still_breaking > 0), "FAIL")
        .when(after == "COMPLETE", "PROVEN")
        .otherwise("REVIEW_REQUIRED")
    )
