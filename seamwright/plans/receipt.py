"""Receipts (M7, M8): patch the client's files, analyse them again, and compare what breaks.

A patched snapshot is another DataFrame of files; nothing is written to a working tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intent as intents
from ..operators import diff, matching, repair
from ..sources.files import ts_imports
from ..sources.modules import module_files
from .check import place_of, snapshot_changes, snapshot_impacts
from .scratch import cut


@dataclass(frozen=True)
class Receipt:
    """One row of `summary`, the consumers (key: place of the call; state fixed, still or new) and the files with their status."""

    summary: DataFrame
    consumers: DataFrame
    files: DataFrame
    impacts: DataFrame
    changes: DataFrame


def verify(intent: dict[str, str], changes: DataFrame, impacts: DataFrame) -> DataFrame:
    """A1: one row (status, breaking, warning, unknown) of an intent's contract."""
    contract, old = intent["contract_id"], intent.get("from", intent.get("field"))
    new = intent.get("to", old)
    bare = lambda c: F.regexp_replace(c["path"], r"^root\.", "")
    listed = F.transform("field_changes", lambda c: F.struct(bare(c).alias("path"), F.when(diff.widened(c), "widened").otherwise(c["kind"]).alias("kind")))
    mine = changes.where(F.col("contract_id") == contract).select("contract_id", F.explode_outer(listed).alias("c")).select("contract_id", "c.path", "c.kind")
    asked = mine.sparkSession.range(1).select(F.lit(contract).alias("contract_id"), F.lit(old).alias("old"), F.lit(new).alias("new"))
    done = intents.carried_out(asked, mine)
    ok = F.col("rename_done") if intent["kind"] == "rename-field" else F.col("widen_done")
    seen = mine.agg(F.count(F.lit(1)).alias("seen"))
    counts = intents.counts(impacts.where(F.col("contract_id") == contract))
    row = done.select(ok.alias("ok")).crossJoin(seen).crossJoin(counts)  # one row each
    return row.select(intents.verdict(F.col("seen") > 0, F.when(F.col("ok"), 0).otherwise(1), F.col("breaking"), F.col("unknown")).alias("status"), "breaking", "warning", "unknown")


def build_receipt(client_files: DataFrame, base_server: DataFrame, current_server: DataFrame, intent: dict[str, str] | None = None, base_client: DataFrame | None = None, threshold: float = matching.THRESHOLD) -> Receipt:
    """M7: what the changes between two server snapshots break, and whether the intent's repair mends it.

    intent: of parse_rename or parse_widen. Without one, or without patches, nothing is analysed again.
    """
    base, current, changes = snapshot_changes(base_server, current_server)
    impacts = cut(snapshot_impacts(changes, client_files, base, current, base_client, threshold))
    total = intents.counts(impacts).select(F.col("breaking").alias("all_breaking"), F.col("unknown").alias("all_unknown"))
    spark = client_files.sparkSession
    none = F.lit(None).cast("string")
    no_consumers = spark.createDataFrame([], "key string, state string")
    flags = [F.lit(intent is not None).alias("has_intent"), F.lit(intent is not None and intent["kind"] in repair.TRANSFORMS).alias("repairable")]
    if intent is None or intent["kind"] not in repair.TRANSFORMS:
        before = verify(intent, changes, impacts).select("status") if intent else spark.range(1).select(none.alias("status"))
        row = total.crossJoin(before).select(*flags, F.col("status").alias("before"), none.alias("after"), "all_breaking", "all_unknown", *[F.lit(0).alias(k) for k in ("fixed", "still", "new", "patched")])
        return Receipt(_judged(row), no_consumers, client_files.select("path", none.alias("status")).limit(0), impacts, changes)
    mine = impacts.where(F.col("contract_id") == intent["contract_id"])
    placed = mine.select(place_of(F.col("consumer_id"))["path"].alias("path"), "severity", "field_level_match", "confidence", "consumer_id")
    placed = placed.withColumn("ord", F.xxhash64("consumer_id"))
    old, new = intent.get("from", intent.get("field")), intent.get("to", "")
    leaf = lambda x: x.rsplit(".", 1)[-1]
    patched = cut(repair.repair_files(client_files, placed, intent["kind"], leaf(old), leaf(new)))
    edited = patched.where("status = 'patched'").count()
    before = verify(intent, changes, impacts)
    key = place_of(F.col("consumer_id"))["key"].alias("key")
    pre = mine.where("severity = 'BREAKING'").select(key).distinct()
    if edited:
        again = cut(snapshot_impacts(changes, patched.select("snapshot", "path", "lang", "text"), base, current, base_client, threshold))
        post = again.where("severity = 'BREAKING'").select(key).distinct()
        after = verify(intent, changes, again)
    else:
        post, after = pre, before
    states = cut(intents.before_after(pre, post))
    n = states.agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("fixed", "still", "new")])
    row = total.crossJoin(before.select(F.col("status").alias("before"))).crossJoin(after.select(F.col("status").alias("after"))).crossJoin(n)
    row = row.select(*flags, "before", "after", "all_breaking", "all_unknown", "fixed", "still", "new", F.lit(edited).alias("patched"))
    return Receipt(_judged(row), states, patched.where("status is not null").select("path", "text", "status"), impacts, changes)


_COUNTS = ("breaking", "unknown")


def _verified(asked: DataFrame, changes: DataFrame, impacts: DataFrame) -> DataFrame:
    """A1 for many intents: (intent_id, status). asked: intent_id, kind, contract_id, old, new; impacts: intent_id, severity."""
    bare = lambda c: F.regexp_replace(c["path"], r"^root\.", "")
    listed = F.transform("field_changes", lambda c: F.struct(bare(c).alias("path"), F.when(diff.widened(c), "widened").otherwise(c["kind"]).alias("change")))
    rows = changes.select("contract_id", F.explode_outer(listed).alias("c")).select(F.col("contract_id").alias("changed"), "c.path", "c.change")
    met = asked.join(rows, F.col("contract_id") == F.col("changed"), "left")
    is_ = lambda path, kind: F.max(F.coalesce((F.col("path") == F.col(path)) & (F.col("change") == kind), F.lit(False)))
    done = met.groupBy("intent_id", "kind").agg(F.count("changed").alias("seen"), is_("old", "removed").alias("gone"), is_("new", "added").alias("come"), is_("old", "widened").alias("wide"))
    ok = F.when(F.col("kind") == "rename-field", F.col("gone") & F.col("come")).otherwise(F.col("wide"))
    n = impacts.groupBy(F.col("intent_id").alias("of")).agg(*[F.count_if(F.col("severity") == k.upper()).alias(k) for k in _COUNTS])
    both = done.join(n, F.col("intent_id") == F.col("of"), "left")
    counts = [F.coalesce(k, F.lit(0)) for k in _COUNTS]
    return both.select("intent_id", intents.verdict(F.col("seen") > 0, F.when(ok, 0).otherwise(1), *counts).alias("status"))


def build_receipts(client_files: DataFrame, base_server: DataFrame, current_server: DataFrame, asked: DataFrame, base_client: DataFrame | None = None, threshold: float = matching.THRESHOLD) -> DataFrame:
    """M7 for many intents at once: (intent_id, before, after, fixed, still, new, patched, verdict) of asked (intent_id, kind, contract_id, old, new).

    The snapshots are compared and the client is analysed once. A file that an intent patches is a version of its own, in a folder of
    that intent, beside the files it imports; all versions are analysed together, and what breaks in files that no patch touched is taken over.
    kind is one of repair.TRANSFORMS; an intent without patches isn't analysed again.
    """
    base, current, changes = snapshot_changes(base_server, current_server)
    impacts = cut(snapshot_impacts(changes, client_files, base, current, base_client, threshold))
    asked = cut(asked.select("intent_id", "kind", "contract_id", "old", "new").withColumn("folder", F.concat(F.lit("i"), F.hex(F.xxhash64("intent_id")))))
    mine = cut(impacts.join(asked.select("intent_id", "folder", "contract_id"), "contract_id").withColumns({"path": place_of(F.col("consumer_id"))["path"], "key": place_of(F.col("consumer_id"))["key"]}))
    leaf = lambda c: F.substring_index(c, ".", -1)
    edits = asked.select(F.col("intent_id").alias("e_id"), "kind", leaf("old").alias("old"), leaf(F.coalesce("new", F.lit(""))).alias("new"))
    versions = cut(repair.repair_versions(client_files, mine.withColumn("ord", F.xxhash64("consumer_id")).join(edits, F.col("intent_id") == F.col("e_id"))).where("status = 'patched'"))
    # what patched files import stands beside them, patched or not; so do settings, which name the aliases
    paths = versions.select("path").distinct()
    named = ts_imports(client_files).join(paths, "path", "left_semi").select("snapshot", "path", "specifier")
    imported = module_files(named, client_files).select("path", "file").distinct()
    beside = versions.select("folder", "path").join(imported, "path").select("folder", F.col("file").alias("path"))
    settings = versions.select("folder").distinct().crossJoin(client_files.where("lang = 'tsconfig'").select("path"))  # settings files of each intent with patches
    others = beside.unionByName(settings).distinct().join(versions.select("folder", "path"), ["folder", "path"], "left_anti").join(client_files.select("path", "lang", "text"), "path")
    tree = versions.select("folder", "path", "lang", "text").unionByName(others.select("folder", "path", "lang", "text"))
    tree = cut(tree.select(F.lit("patched").alias("snapshot"), F.concat_ws("/", "folder", "path").alias("path"), "lang", "text"))
    again = snapshot_impacts(changes, tree, base, current, tree if base_client is not None else None, threshold)
    again = again.select("contract_id", F.split_part("consumer_id", F.lit("/"), F.lit(1)).alias("folder"), F.expr("substring(consumer_id, instr(consumer_id, '/') + 1)").alias("consumer_id"), "severity")
    again = again.withColumns({"path": place_of(F.col("consumer_id"))["path"], "key": place_of(F.col("consumer_id"))["key"]})
    again = again.join(asked.select("intent_id", "folder", "contract_id"), ["folder", "contract_id"]).join(versions.select("folder", "path"), ["folder", "path"], "left_semi")
    kept = mine.join(versions.select("folder", "path"), ["folder", "path"], "left_anti")
    columns = ["intent_id", "key", "severity"]
    after = cut(kept.select(*columns).unionByName(again.select(*columns)))
    breaks = lambda rows, name: rows.where("severity = 'BREAKING'").select("intent_id", "key", F.lit(name).alias("side"))
    sides = breaks(mine, "pre").unionByName(breaks(after, "post")).groupBy("intent_id", "key").agg(F.max(F.col("side") == "pre").alias("pre"), F.max(F.col("side") == "post").alias("post"))
    count = lambda pre, post, name: F.count_if((F.col("pre") == pre) & (F.col("post") == post)).alias(name)
    states = sides.groupBy(F.col("intent_id").alias("s_id")).agg(count(True, False, "fixed"), count(True, True, "still"), count(False, True, "new"))
    edited = versions.groupBy(F.col("folder").alias("v_folder")).agg(F.count(F.lit(1)).alias("patched"))
    first, last = (_verified(asked, changes, rows).select(F.col("intent_id").alias(f"{n}_id"), F.col("status").alias(n)) for rows, n in ((mine, "before"), (after, "after")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    row = asked.select("intent_id", "folder").join(first, F.expr("intent_id = before_id")).join(last, F.expr("intent_id = after_id")).join(states, F.expr("intent_id = s_id"), "left").join(edited, F.expr("folder = v_folder"), "left")
    row = row.select("intent_id", "before", "after", zero("fixed"), zero("still"), zero("new"), zero("patched"))
    yes, none = F.lit(True), F.lit(0)
    return row.withColumn("verdict", repair.receipt_verdict(yes, yes, F.col("before"), F.col("after"), none, none, F.col("new"), F.col("still"), F.col("patched")))


def _judged(row: DataFrame) -> DataFrame:
    c = F.col
    return row.withColumn("verdict", repair.receipt_verdict(c("has_intent"), c("repairable"), c("before"), c("after"), c("all_breaking"), c("all_unknown"), c("new"), c("still"), c("patched")))
