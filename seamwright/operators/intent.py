"""Intent verification and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HINT_CAP = 5


def carried_out(asked: DataFrame, changes: DataFrame) -> DataFrame:
    """A1: rename_done and widen_done of each asked (contract_id, old, new); changes: (contract_id, path, kind), kind `widened` for false -> true."""
    j = asked.join(changes, "contract_id", "left").groupBy("contract_id").agg(
        F.max((F.col("path") == F.col("old")) & (F.col("kind") == "removed")).alias("gone"),
        F.max((F.col("path") == F.col("new")) & (F.col("kind") == "added")).alias("come"),
        F.max((F.col("path") == F.col("old")) & (F.col("kind") == "widened")).alias("wide"),
    )
    no = F.lit(False)
    return j.select("contract_id", (F.coalesce("gone", no) & F.coalesce("come", no)).alias("rename_done"), F.coalesce("wide", no).alias("widen_done"))


def verdict(contract_changed: Column, mismatches: Column, breaking: Column, unknown: Column) -> Column:
    """A1: warnings don't block."""
    return F.when(~contract_changed, "UNVERIFIED").when((mismatches == 0) & (breaking == 0) & (unknown == 0), "COMPLETE").otherwise("INCOMPLETE")


def summary_verdict(breaking: Column, warning: Column, unknown: Column) -> Column:
    """A3: without an intent. Warnings don't count."""
    return F.when(breaking > 0, "FAIL").when(unknown > 0, "REVIEW_REQUIRED").otherwise("PASS")


def intent_flag(kind: Column, contract: Column, old: Column, new: Column) -> Column:
    """The option of the command line that states an intent."""
    rename = F.concat(F.lit("--rename="), contract, F.lit("."), old, F.lit("->"), contract, F.lit("."), new)
    return F.when(kind == "widen-optionality", F.concat(F.lit("--widen-optional="), contract, F.lit("."), old)).otherwise(rename)


def explanation_text(segments: Column, alignment: Column, depth: Column) -> Column:
    """One line of a scored match. segments: ARRAY<STRUCT<client, server, kind, score>>."""
    sign = lambda s: F.when(s["kind"] == "static-exact", "=").when(s["kind"] == "unaligned", "vs").otherwise("≈")
    one = F.transform(segments, lambda s: F.concat(s["client"], sign(s), s["server"], F.lit("("), s["score"].cast("string"), F.lit(")")))
    return F.concat(F.array_join(one, " + "), F.format_string(" — alignment %.2f, depth-agreement %.2f", alignment, depth))


#: Kinds of intent that a repair exists for.
REPAIRABLE = ("rename-field", "widen-optionality")


def agent_summary(rows: DataFrame) -> DataFrame:
    """A2-A5: rows with summary_verdict, repair_available and next_actions.

    rows: breaking, warning, unknown (counts), breaking_files, warning_files, unknown_files (hints); kind and flag of the intent, null
    without one; status of its verification, null before it; applied, patches, skipped (number) and skip_reasons of a repair, null without one.
    """
    c, has = F.col, lambda k: F.col(k) > 0
    repaired, verified = c("kind").isNotNull() & c("patches").isNotNull(), c("kind").isNotNull() & c("patches").isNull() & c("status").isNotNull()
    able = F.coalesce(c("kind").isin(*REPAIRABLE), F.lit(False))
    say = lambda text, *cols: F.format_string(text, *[F.col(k) if isinstance(k, str) else k for k in cols])
    manual = F.when(has("unknown"), say("%d consumers cannot be resolved statically and need a manual review: %s", "unknown", "unknown_files"))
    plain = F.array_compact(
        F.array(
            F.when(has("breaking"), say("%d consumers break; state the change with --rename or --widen-optional to have a repair tried: %s", "breaking", "breaking_files")),
            manual,
            F.when(~has("breaking") & ~has("unknown"), F.lit("Nothing to do.")),
        )
    )
    open_ = F.array_compact(
        F.array(
            F.when(has("breaking") & able, say("Run `seamwright fix %s --apply` to repair %d breaking consumers: %s", "flag", "breaking", "breaking_files")),
            F.when(has("breaking") & ~able, say("%d consumers break and no repair exists for %s: %s", "breaking", "kind", "breaking_files")),
            manual,
            F.when(has("warning"), say("%d consumers may depend on the contract; review them: %s", "warning", "warning_files")),
        )
    )
    checked = F.when(c("status") == "UNVERIFIED", F.array(F.lit("The intent does not match the observed changes; check the contract and field names."))).when(c("status") == "COMPLETE", F.array(F.lit("Nothing to do: all consumers are compatible."))).otherwise(open_)
    outcome = F.when(c("applied"), "APPLIED").when(has("patches"), "DRY_RUN").otherwise("NO_REPAIR_AVAILABLE")
    first = (
        F.when(outcome == "APPLIED", say("%d files are patched; `seamwright receipt %s` proves the result.", "patches", "flag"))
        .when(outcome == "DRY_RUN", say("%d patches are ready; run `seamwright receipt %s`, then fix with --apply.", "patches", "flag"))
        .when(has("skipped"), say("No patch is safe (%d files skipped): %s", "skipped", F.array_join(F.slice("skip_reasons", 1, HINT_CAP), "; ")))
        .otherwise("Nothing to repair.")
    )
    done = F.array_compact(F.array(first, manual))
    return rows.withColumns(
        {
            "summary_verdict": F.when(repaired, outcome).when(verified, c("status")).otherwise(summary_verdict(c("breaking"), c("warning"), c("unknown"))),
            "repair_available": F.when(repaired, has("patches")).when(verified, able & has("breaking")).otherwise(False),
            "next_actions": F.when(repaired, done).when(verified, checked).otherwise(plain),
        }
    )


def counts(impacts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A7."""
    return impacts.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("BREAKING", "WARNING", "SAFE", "UNKNOWN")])


def hints(rows: DataFrame, cap: int = HINT_CAP) -> DataFrame:
    """The first `cap` hints of each key by ord, and how many more. Only `cap` of a key are ever kept together."""
    from pyspark.sql import Window

    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("ord", "hint"))).where(F.col("k") <= cap)
    shown = top.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "hint"))), lambda x: x["hint"]), ", ").alias("shown"))
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > cap, F.format_string(" +%d more", F.col("n") - cap)).otherwise("")
    return shown.join(n, "key").select("key", F.concat("shown", more).alias("hints"))


def scope_mismatch(rows: DataFrame) -> DataFrame:
    """No match, three or more unresolved calls, all of them static; the first segment they share. rows: key, matches, reason, first."""
    g = rows.groupBy("key").agg(
        F.sum("matches").alias("matches"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("reason") == "no-dynamic-route").alias("static"),
        F.min("first").alias("lo"),
        F.max("first").alias("hi"),
    )
    return g.select("key", ((F.col("matches") == 0) & (F.col("n") >= 3) & (F.col("n") == F.col("static"))).alias("is_mismatch"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("shared"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys fixed, still breaking, or new."""
    return (
        before.join(after, "key", "left_anti").select("key", F.lit("fixed").alias("state"))
        .unionByName(before.join(after, "key", "left_semi").select("key", F.lit("still").alias("state")))
        .unionByName(after.join(before, "key", "left_anti").select("key", F.lit("new").alias("state")))
    )


def parse_rename(text: str) -> dict[str, str]:
    """A10: `contract.old->contract.new`, or `contract.old=new`; the contract's id ends at the first dot."""
    found = re.fullmatch(r"([^.]+)\.(.+?)->[^.]+\.(.+)", text.strip()) or re.fullmatch(r"([^.]+)\.([^=]+)=(.+)", text.strip())
    if not found:
        raise ValueError(f"rename must read contract.old->contract.new: {text!r}")
    return {"kind": "rename-field", "contract_id": found[1], "from": found[2], "to": found[3]}


def parse_widen(text: str) -> dict[str, str]:
    """A10: `contract.field`."""
    head, dot, tail = text.strip().partition(".")
    if not (head and dot and tail):
        raise ValueError(f"widening must read contract.field: {text!r}")
    return {"kind": "widen-optionality", "contract_id": head, "field": tail}
