"""Route templates as Column factories.

A segment is STRUCT<kind, value>: kind is static or dynamic, value the text or the parameter's name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<kind:string,value:string>>"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")


def clean_raw(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^\s+|\s+$", "")


def parse_route(raw: Column) -> Column:
    """Segments of a raw route; the part from the first '?' on doesn't count, empty parts neither."""
    parts = F.filter(F.split(F.regexp_extract(clean_raw(raw), r"^[^?]*", 0), "/"), lambda p: p != "")

    def segment(p: Column) -> Column:
        dynamic = lambda name: F.struct(F.lit("dynamic").alias("kind"), name.alias("value"))
        inner = F.regexp_extract(p, r"^(?:\[{1,2}\.\.\.(\w+)\]{1,2}|\[(\w+)\]|\{(\w+)\})$", 0)
        name = F.regexp_extract(p, r"^[\[{.]+(\w+)[\]}]+$", 1)
        star = F.substring(p, 2, 1 << 30)
        return (
            F.when(F.startswith(p, F.lit(":")), dynamic(star))
            .when(inner != "", dynamic(name))
            .when(F.startswith(p, F.lit("*")), dynamic(F.when(star == "", "wildcard").otherwise(star)))
            .when(p == "__DYN__", dynamic(F.lit("?")))
            .otherwise(F.struct(F.lit("static").alias("kind"), p.alias("value")))
        )

    return F.transform(parts, segment)


def render_segment(s: Column) -> Column:
    return F.when(s["kind"] == "dynamic", F.concat(F.lit(":"), s["value"])).otherwise(s["value"])


def stringify_route(segments: Column) -> Column:
    """R2: `/a/:b`; `/` without segments."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, render_segment), "/"))


def exact_key(segments: Column) -> Column:
    """Two routes match exactly if their keys are equal; no static segment holds a slash or starts with ':'."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s["kind"] == "dynamic", ":").otherwise(s["value"])), "/"))


def token_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, 0 at least."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longest))


def segment_score(c: Column, s: Column) -> Column:
    """0.85 where either is dynamic, else the similarity."""
    return F.when((c["kind"] == "dynamic") | (s["kind"] == "dynamic"), F.lit(0.85)).otherwise(token_similarity(c["value"], s["value"]))


def segment_kind(c: Column, s: Column) -> Column:
    return F.when((c["kind"] == "dynamic") | (s["kind"] == "dynamic"), "dynamic-compatible").when(c["value"] == s["value"], "static-exact").otherwise("static-fuzzy")


def round_half_up(x: Column, digits: int) -> Column:
    unit = float(10**digits)
    return F.floor(x * unit + 0.5) / unit


def alignment_total(client: Column, server: Column) -> Column:
    n = F.least(F.size(client), F.size(server))
    pairs = F.zip_with(F.slice(client, F.lit(1), n), F.slice(server, F.lit(1), n), segment_score)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def alignment_parts(client: Column, server: Column) -> tuple[Column, Column]:
    """(alignment score, length agreement) of R8."""
    longest, shortest = F.greatest(F.size(client), F.size(server)), F.least(F.size(client), F.size(server))
    none = longest == 0
    return (
        F.when(none, F.lit(1.0)).otherwise(alignment_total(client, server) / F.greatest(longest, F.lit(1))),
        F.when(none, F.lit(1.0)).otherwise(shortest / F.greatest(longest, F.lit(1))),
    )


def route_score(client: Column, server: Column) -> Column:
    """Alignment x (0.7 + 0.3 x length agreement)."""
    aligned, agreement = alignment_parts(client, server)
    return aligned * (F.lit(0.7) + F.lit(0.3) * agreement)


def explain_route(client: Column, server: Column) -> Column:
    """Evidence by segment, scores to three digits; a missing one shows as the empty-set sign with score 0."""
    longest = F.greatest(F.size(client), F.size(server))
    at = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))

    def evidence(i: Column) -> Column:
        c, s = F.get(client, i), F.get(server, i)
        both = c.isNotNull() & s.isNotNull()
        return F.struct(
            i.alias("index"),
            F.when(c.isNull(), "∅").otherwise(render_segment(c)).alias("client"),
            F.when(s.isNull(), "∅").otherwise(render_segment(s)).alias("server"),
            F.when(both, segment_kind(c, s)).otherwise("unaligned").alias("kind"),
            F.when(both, round_half_up(segment_score(c, s), 3)).otherwise(F.lit(0.0)).alias("score"),
        )

    return F.transform(at, evidence)


def normalize_method(method: Column) -> Column:
    """Upper case, UNKNOWN outside the known verbs."""
    up = F.upper(method)
    return F.when(up.isin(*METHODS), up).otherwise("UNKNOWN")
