"""URL filters: path rules first, then association rules mined by FP-growth from labelled pages.

A page's label is that of the document whose number ends its url's path: bad where quality is 0 or
toxic is 1. FP-growth mines the token sets of labelled urls together with the item BAD; rules
`tokens => BAD` that reach the least support, confidence and odds ratio stay, unless a rule of fewer of their tokens is as
confident. The odds of bad with the tokens over those without them can be large whatever the share of bad urls is. Rules are indexed under their
rarest token; a token set is blocked if it holds all tokens of one. Each distinct token set is
judged once, so that one hot host costs no more than another, and verdicts are joined to pages salted. Only DataFrame operations and
Spark's own FP-growth are used.

A null url, or one without `://`, has an empty host and path and no tokens: it is allowed.
Repeated rows are judged alike. An empty table gives an empty result, and without labels no rule is mined. Very long urls have more tokens, no more.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BAD = "label:bad"
#: Shares of the labelled urls, at every size of the table.
MIN_SUPPORT, MIN_CONFIDENCE = 0.004, 0.5
#: The odds of bad with a rule's tokens over those without; else tokens of every url would block where bad ones are common.
MIN_ODDS = 2.0
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Path rules of the registered query: (verdict, host and path).
PATH_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def path_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule (struct of size, rule, verdict) whose host is the url's or a parent of it and whose path begins the url's."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = []
    for verdict, rule in rules:
        own, slash, tail = rule.partition("/")
        hit = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + tail))
        fits.append(F.when(hit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens: h: labels and words of the host, p: words of the path, q: names of the query."""
    words = lambda c, kind: F.transform(F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit("[a-z][a-z0-9_]*"), F.lit(0)), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "\\?([^#]*)", 1)
    names = F.transform(F.regexp_extract_all(query, F.lit("(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.array_sort(F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), names)))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, support) for BAD. pages: (tokens, path); labels: (doc_id, quality, toxic)."""
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    named = pages.select("tokens", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 0, false) or coalesce(toxic = 1, false)")).alias("bad"))
    baskets = named.join(bad, "doc_id").select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")).where("size(items) > 0")
    baskets = materialize(baskets, "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    all_bad, here = F.col("confidence") / F.col("lift"), F.col("support") / F.col("confidence")
    odds = F.col("confidence") * (1 - here - all_bad + F.col("support")), MIN_ODDS * (1 - F.col("confidence")) * (all_bad - F.col("support"))
    # a difference of shares may be off by rounding; urls that all hold the tokens tell nothing
    found = rules.where((odds[0] >= odds[1]) & (odds[0] > 1e-12)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    return materialize(pruned(materialize(found, "rules")), "rules")


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that hold all tokens of another rule at least as confident; found by the rarest-token index, as urls are."""
    other = rarest(rules).select(F.col("needed").alias("o_tokens"), F.col("confidence").alias("o_confidence"), "token")
    mine = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    part = (F.size("o_tokens") < F.size("tokens")) & (F.col("o_confidence") >= F.col("confidence")) & (F.size(F.array_except("o_tokens", "tokens")) == 0)
    lesser = mine.join(other, "token").where(part).select("tokens").distinct()
    return rules.join(lesser, "tokens", "left_anti")


def rarest(rules: DataFrame) -> DataFrame:
    """The inverted index: (needed, confidence, token), each rule under the token that fewest rules hold."""
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    indexed = each.join(each.groupBy("token").count(), "token")
    return indexed.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token")).withColumnRenamed("tokens", "needed")


def blocked_sets(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (tokens, confidence) that hold all tokens of a rule, by the rules' inverted index."""
    sets = pages.select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(rarest(rules), "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = PATH_RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("url")))
    blocked = blocked_sets(split, mine(split.select("tokens", "path"), labels, min_support, min_confidence))
    spread = blocked.select(F.col("tokens").alias("held"), "confidence", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of"))
    chosen = path_rule(F.col("host"), F.col("path"), rules)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    out = split.select("page_id", "host", "path", chosen.alias("chosen"), "tokens", salt.alias("salt"))
    out = out.join(spread, (out["tokens"] == spread["held"]) & (out["salt"] == spread["of"]), "left")
    verdict = F.coalesce(F.col("chosen.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("chosen.rule").alias("rule"), verdict.alias("verdict"), "confidence")
