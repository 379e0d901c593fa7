"""Impact of contract changes on consumers (I1-I3) and risk (K1-K6)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routes import round_half_up
from .graph import proof_level, proof_rank


def classify_impacts(pairs: DataFrame) -> DataFrame:
    """I2 for each changed contract and reachable consumer.

    pairs: contract_id, consumer_id, change_kind, dynamic, accessed ARRAY<STRING>, unguarded ARRAY<STRING>, changes
    ARRAY<STRUCT<path, kind, widened>> (paths without `root.`), resolution and edge_confidence of the direct consumes edge (null
    without one), node_confidence.
    """
    accessed, changes = F.coalesce("accessed", F.array().cast("array<string>")), F.col("changes")
    broken = F.filter(changes, lambda c: c["kind"] != "added")
    hits = F.filter(broken, lambda c: F.exists(accessed, lambda a: (c["path"] == a) | F.endswith(c["path"], F.concat(F.lit("."), a))))
    hit = F.get(hits, F.lit(0))
    leaf = F.regexp_extract(hit["path"], r"([^.]*)$", 1)
    guarded = hit["widened"] & ~F.array_contains(F.coalesce("unguarded", F.array().cast("array<string>")), leaf)
    found, edge = F.size(hits) > 0, F.col("edge_confidence").isNotNull()
    dynamic, removed, used = F.coalesce("dynamic", F.lit(False)), F.col("change_kind") == "removed", F.size(accessed) > 0
    confidence = F.coalesce("edge_confidence", "node_confidence")
    level = proof_level(F.col("resolution"), confidence, F.lit(False), F.lit(False))
    capped = F.when(proof_rank(level) > 1, "POTENTIAL").otherwise(level)
    near = F.when(edge, "DIRECT").otherwise("TRANSITIVE")
    case = lambda d, r, g, h, u, n: F.when(dynamic, d).when(removed, r).when(found & guarded, g).when(found, h).when(used, u).otherwise(n)
    paths = F.transform(changes, lambda c: c["path"])
    none = F.array().cast("array<string>")
    return pairs.select(
        "contract_id",
        "consumer_id",
        case(F.lit("UNKNOWN"), near, near, near, F.lit("UNUSED"), F.lit("POTENTIAL")).alias("category"),
        case(*map(F.lit, ("UNKNOWN", "BREAKING", "SAFE", "BREAKING", "SAFE", "WARNING"))).alias("severity"),
        case(
            F.lit("Dynamic/computed access cannot be statically proven."),
            F.lit("The consumed contract was removed."),
            F.concat(F.lit("Field '"), hit["path"], F.lit("' widened from required to optional, but the consumer's access is guarded (optional-chained or not further dereferenced).")),
            F.concat(F.lit("Consumer accesses changed field '"), hit["path"], F.lit("'.")),
            F.lit("Known static accesses do not intersect changed fields."),
            F.lit("Consumer dependency is known, but field-level usage could not be proven."),
        ).alias("reason"),
        case(*map(F.lit, (False, True, True, True, False, False))).alias("field_level_match"),
        case(paths, none, F.array(hit["path"]), F.array(hit["path"]), paths, paths).alias("changed_paths"),
        confidence.alias("confidence"),
        case(F.lit("UNKNOWN"), level, level, level, level, capped).alias("proof_level"),
        "ord",
    )


def dedupe_impacts(impacts: DataFrame) -> DataFrame:
    """Of several impacts on one consumer of one contract that of highest confidence, the first of equals."""
    keys = ["contract_id", "consumer_id"]
    values = [c for c in impacts.columns if c not in keys]
    best = impacts.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(-F.col("confidence"), F.col("ord"))).alias("v"))
    return best.select(*keys, "v.*")


def summarize(impacts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by severity and the four ratios."""
    n = F.count(F.lit(1))
    is_ = lambda s: F.count_if(F.col("severity") == s)
    share = lambda x: F.least(F.lit(1.0), x / F.greatest(n, F.lit(1)))
    return impacts.groupBy(*by).agg(
        is_("BREAKING").alias("breaking"),
        is_("WARNING").alias("warning"),
        is_("SAFE").alias("safe"),
        is_("UNKNOWN").alias("unknown"),
        F.count_if(F.col("category") == "TRANSITIVE").alias("transitive"),
        share(is_("BREAKING")).alias("confirmed_breaking"),
        share(is_("WARNING")).alias("potential_breaking"),
        F.lit(0).alias("high_criticality_consumers"),
        F.least(F.lit(1.0), n / (n + 5)).alias("total_consumers"),
        share(is_("UNKNOWN")).alias("unresolved_unknowns"),
    )


@dataclass(frozen=True)
class RiskConfig:
    """K3: the default weights are fixed values."""

    breaking: float = 16
    unknown: float = 10
    public_bonus: float = 20
    transitive_threshold: int = 3
    transitive_bonus: float = 25
    multipliers: Mapping[str, float] = field(default_factory=lambda: {"TIER_0_CRITICAL": 1.5, "TIER_1_HIGH": 1.2, "TIER_2_MEDIUM": 1.0, "TIER_3_LOW": 0.7})
    levels: tuple[float, float, float] = (75, 50, 25)

    def __post_init__(self) -> None:
        """K2."""
        numbers = [self.breaking, self.unknown, self.public_bonus, self.transitive_threshold, self.transitive_bonus, *self.multipliers.values(), *self.levels]
        if any(not 0 <= x < float("inf") for x in numbers):
            raise ValueError("risk settings must be finite and not negative")
        critical, high, medium = self.levels
        if not medium <= high <= critical <= 100:
            raise ValueError("risk levels must rise from medium to critical, 100 at most")


def risk(counts: DataFrame, config: RiskConfig | None = None, custom: Column | None = None) -> DataFrame:
    """K1: risk_score and risk_level added to counts (breaking, unknown, transitive, tier, is_public, environment).

    custom: points of further rules, such as sensitive_points.
    """
    c = config or RiskConfig()
    pairs = [x for kv in c.multipliers.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]
    m = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("tier", F.lit("TIER_2_MEDIUM"))), F.lit(1.0))
    whole = lambda x: round_half_up(x, 0)
    points = (
        whole(F.col("breaking") * float(c.breaking) * m)
        + whole(F.col("unknown") * float(c.unknown) * m)
        + F.when(F.coalesce("is_public", F.lit(False)), float(c.public_bonus)).otherwise(0.0)
        + F.when(F.col("transitive") > c.transitive_threshold, float(c.transitive_bonus)).otherwise(0.0)
        + F.when((F.col("environment") == "production") & (F.col("breaking") > 0), whole(F.lit(c.breaking * 0.25))).otherwise(0.0)
        + (custom if custom is not None else F.lit(0.0))
    )
    score = F.least(F.lit(100), F.greatest(F.lit(0), whole(points).cast("int")))
    critical, high, medium = c.levels
    level = F.when(F.col("risk_score") >= critical, "CRITICAL").when(F.col("risk_score") >= high, "HIGH").when(F.col("risk_score") >= medium, "MEDIUM").otherwise("LOW")
    return counts.withColumn("risk_score", score).withColumn("risk_level", level)


def sensitive_points(changed_paths: Column, sensitive: list[str], points: float = 25) -> Column:
    """K4: points if any changed path, or its leaf, is a sensitive field."""
    names = F.array(*[F.lit(s) for s in sensitive]) if sensitive else F.array().cast("array<string>")
    hit = F.exists(changed_paths, lambda p: F.array_contains(names, p) | F.array_contains(names, F.regexp_extract(p, r"([^.]*)$", 1)))
    return F.when(hit, float(points)).otherwise(0.0)


TIERS = ("TIER_0_CRITICAL", "TIER_1_HIGH", "TIER_2_MEDIUM", "TIER_3_LOW")


def resolve_service(rows: DataFrame, services: DataFrame) -> DataFrame:
    """K5: rows (key, name, path) with tier, is_public and environment of their service.

    services: service, path_prefix, tier, is_public, environment, a small configuration. An explicit name wins, then a path that
    holds the prefix (lower case, the smallest service name), then the path's last part; else tier 2, not public.
    """
    s = F.broadcast(services)  # a configuration file's rows
    prefix = F.lower("path_prefix")
    rank = F.when(F.col("name") == F.col("service"), 1).when(prefix.isNotNull() & (prefix != "") & F.contains(F.lower("path"), prefix), 2).when(F.regexp_extract("path", r"([^/]*)/*$", 1) == F.col("service"), 3)
    met = rows.join(s, (F.col("name") == F.col("service")) | F.contains(F.lower("path"), prefix) | (F.regexp_extract("path", r"([^/]*)/*$", 1) == F.col("service")), "left")
    best = met.withColumn("rank", rank).groupBy("key").agg(F.min_by(F.struct("service", "tier", "is_public", "environment"), F.struct(F.coalesce("rank", F.lit(9)), "service")).alias("s"))
    return best.select("key", F.col("s.service").alias("service"), F.coalesce("s.tier", F.lit("TIER_2_MEDIUM")).alias("tier"), F.coalesce("s.is_public", F.lit(False)).alias("is_public"), F.col("s.environment").alias("environment"))


def validate_services(services: dict[str, dict]) -> list[str]:
    """K6: what is wrong with a configuration's services."""
    out = [f"service name must not be empty (entry {k})" for k, name in enumerate(services) if not name.strip()]
    return out + [f"service '{name}' has unknown criticality '{s['criticality']}'" for name, s in services.items() if s.get("criticality") not in (None, *TIERS)]
