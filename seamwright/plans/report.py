"""Reports (S19-S26): findings as ordered lines, rendered in Spark and streamed from there.

A Report is a head, lines in an order that tasks share by ranges, and a tail; head and tail come from counts. Lines are written as
text by the tasks, and `emit` passes them on one by one, so no report has to fit on the driver. SARIF logs of
many files, one by each task, are written by the data source of sources/sarif.py.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Callable
from typing import NamedTuple, TextIO

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .check import place_of
from .scratch import cut, scratch_root

# Fixed values of the SARIF format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


class Report(NamedTuple):
    """lines: one column `value`, in order, without line feeds; between: what stands between two lines, before the line feed."""

    head: str
    lines: DataFrame
    tail: str
    between: str = ""


def emit(report: Report, out: TextIO) -> None:
    """Write a report. Its lines are computed and written by the tasks; here they are only copied, one at a time."""
    folder = f"{scratch_root(report.lines.sparkSession)}/seamwright/report-{uuid.uuid4().hex}"
    report.lines.write.text(folder)
    store, at = fs.FileSystem.from_uri(folder)
    try:
        out.write(report.head)
        first = True
        for part in sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-")):
            with store.open_input_stream(part) as raw:
                for line in io.TextIOWrapper(raw, "utf-8", newline="\n"):
                    out.write(("" if first else f"{report.between}\n") + line.removesuffix("\n"))
                    first = False
        out.write(report.tail)
    finally:
        store.delete_dir(at)


def written(report: Report) -> str:
    """A small report as a string."""
    out = io.StringIO()
    emit(report, out)
    return out.getvalue()


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def relative(path: Column, base: str) -> Column:
    """POSIX path below base; one outside it stays as it is."""
    clean = F.regexp_replace(path, r"\\", "/")
    return F.when(F.startswith(clean, F.lit(base)), F.substring(clean, len(base) + 1, 1 << 30)).otherwise(clean)


def level(kind: Column) -> Column:
    return F.when(kind == "unresolved-route", "note").otherwise("error")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, level and number of results of findings (kind, file) that have a place."""
    rows = findings.where("file is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("results"))
    return rows.select(F.col("kind").alias("rule_id"), "results", level(F.col("kind")).alias("level"))


def _log(results: DataFrame, rules: list[dict], tool: str) -> Report:
    """One SARIF log of results (value: JSON, in order)."""
    driver = json.dumps({"name": tool, "rules": rules})
    head = f'{{"$schema": {json.dumps(SARIF_SCHEMA)}, "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": {driver}}}, "results": [\n'
    return Report(head, results, "\n]}]}\n", ",")


def _place() -> Column:
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    return F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Findings (ord, kind, severity, message, file, line, column) that have a place, as rows of the SARIF source: rule_id, level, message, file, line, column."""
    ordered = findings.where("file is not null").orderBy("ord", "file", "line", "column", "kind")
    return ordered.select(F.col("kind").alias("rule_id"), F.col("severity").alias("level"), "message", "file", F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"))


def sarif(findings: DataFrame, tool: str = "seamwright") -> Report:
    """A SARIF log of findings."""
    rules = [{"id": r["rule_id"], "defaultConfiguration": {"level": r["level"]}} for r in sarif_rules(findings).orderBy("rule_id").collect()]  # one for each kind of finding
    body = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), _place().alias("locations"))
    return _log(sarif_results(findings).select(F.to_json(body).alias("value")), rules, tool)


def _sorted(findings: DataFrame) -> DataFrame:
    return findings.orderBy("ord", "file", "line", "column", "kind")


def _at() -> Column:
    return F.concat(F.coalesce("file", F.lit("None")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("None")))


def markdown(findings: DataFrame, title: str = "Contract check") -> Report:
    """A comment with a marker line; a short one where nothing was found."""
    head = f"<!-- {title.lower().replace(' ', '-')} -->\n## {title}\n\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "kind", _at(), one_line(F.col("message"))), F.lit(" |"))
    lines = _sorted(findings).select(line.alias("value"))
    if findings.isEmpty():
        return Report(head + "No contract violations found.\n", lines, "")
    return Report(head + "| Severity | Kind | Place | Message |\n|---|---|---|---|\n", lines, "\n")


def text(findings: DataFrame) -> Report:
    """S23."""
    n = findings.count()
    line = F.concat(F.rpad(F.upper("severity"), 8, " "), "kind", F.lit(" "), _at(), F.lit(" "), one_line(F.col("message")))
    return Report("", _sorted(findings).select(line.alias("value")), ("\n" if n else "") + f"{n} finding{'' if n == 1 else 's'}\n")


def json_rows(rows: DataFrame, *order: str) -> Report:
    """Rows as one JSON list."""
    ordered = rows.orderBy(*order)
    return Report("[\n", ordered.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value")), "\n]\n", ",")


def impact_findings(impacts: DataFrame) -> DataFrame:
    """rule_id, level, message, file, line, column and the impact's own columns of every impact (contract_id, consumer_id, category, severity, ...)."""
    severity, place = F.col("severity"), place_of(F.col("consumer_id").cast("string"))
    grade = F.when(severity == "BREAKING", "error").when(severity == "WARNING", "warning").otherwise("note")
    message = F.format_string("%s [%s, confidence %d%%]", "reason", "category", F.floor(F.coalesce("confidence", F.lit(0.0)) + 0.5).cast("long"))
    return impacts.select(
        F.concat(F.lit("impact-"), F.lower(severity)).alias("rule_id"),
        grade.alias("level"),
        message.alias("message"),
        place["path"].alias("file"),
        F.coalesce(place["line"], F.lit(1)).alias("line"),
        F.coalesce(place["column"], F.lit(1)).alias("column"),
        "severity",
        "category",
        "reason",
        "confidence",
        "proof_level",
        "contract_id",
        "consumer_id",
    )


def _ordered(impacts: DataFrame) -> DataFrame:
    return cut(impact_findings(impacts)).orderBy("contract_id", "file", "line", "column", "consumer_id")


def impact_sarif(impacts: DataFrame, risk: dict, tool: str = "seamwright") -> Report:
    """A SARIF log of impacts, and of the risk (risk_score, risk_level) unless it is low."""
    rows = _ordered(impacts)
    used = rows.groupBy("rule_id").agg(F.min(F.struct("contract_id", "file", "line", "column", "consumer_id", "reason", "level")).alias("x")).orderBy("rule_id").collect()  # one for each severity
    rules = [{"id": r["rule_id"], "fullDescription": {"text": r["x"]["reason"]}, "defaultConfiguration": {"level": r["x"]["level"]}} for r in used]
    own = F.struct(F.col("contract_id").alias("contractId"), F.col("category").alias("dependencyCategory"), "confidence")
    body = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), _place().alias("locations"), own.alias("properties"))
    log = _log(rows.select(F.to_json(body).alias("value")), rules, tool)
    if risk["risk_level"] == "LOW":
        return log
    key, level = f"contract-risk-{risk['risk_level'].lower()}", "error" if risk["risk_level"] == "CRITICAL" else "warning"
    told = f"Risk score {risk['risk_score']} of 100"
    rules.append({"id": key, "fullDescription": {"text": told}, "defaultConfiguration": {"level": level}})
    last = json.dumps({"ruleId": key, "level": level, "message": {"text": told}, "properties": {"riskScore": risk["risk_score"], "riskLevel": risk["risk_level"]}})
    log = _log(log.lines, rules, tool)
    return log._replace(tail=("" if rows.isEmpty() else ",\n") + last + log.tail)


def impact_markdown(impacts: DataFrame, risk: dict, verdict: str, actions: list[str]) -> Report:
    """A comment on impacts, with the verdict and what to do next."""
    rows = _ordered(impacts)
    n = dict.fromkeys(("BREAKING", "WARNING", "SAFE", "UNKNOWN"), 0) | {r["severity"]: r["n"] for r in rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    worst = next((k for k in ("BREAKING", "WARNING") if n[k]), "CLEAN")
    head = ["<!-- seamwright-impact-report -->", f"### {worst}: contract impact", "", f"**Risk:** {risk['risk_level']} ({risk['risk_score']}/100)", "", " · ".join(f"{v} {k.lower()}" for k, v in n.items()), "", ""]
    line = F.concat(F.lit("- **"), "severity", F.lit("** ["), "category", F.lit("] "), one_line(F.coalesce("reason", F.lit(""))), F.lit(" `"), _at(), F.lit("` (proof: "), F.coalesce("proof_level", F.lit("None")), F.lit(")"))
    return Report("\n".join(head), rows.select(line.alias("value")), "\n".join(["", "", f"**Verdict:** {verdict}", "", *[f"- {a}" for a in actions], ""]))


def validation_text(faults: DataFrame) -> Report:
    """Faults of a graph (code, severity, subject), errors first."""
    n, errors = faults.agg(F.count(F.lit(1)), F.count_if(F.col("severity") == "error")).first()
    line = F.concat(F.lit("  "), F.upper("severity"), F.lit(" ["), "code", F.lit("] "), one_line(F.col("subject")))
    lines = faults.orderBy("severity", "code", "subject").select(line.alias("value"))
    if not n:
        return Report("The contract graph is valid.\n", lines, "")
    return Report(f"Contract graph: {'INVALID' if errors else 'VALID (with warnings)'}\n{errors} errors, {n - errors} warnings\n\n", lines, "\n")


def render(findings: DataFrame, kind: str) -> Report:
    """Findings in one of the formats of the command line."""
    if kind == "json":
        return json_rows(findings, "file", "line", "ord", "kind")
    forms: dict[str, Callable[[DataFrame], Report]] = {"text": text, "markdown": markdown, "sarif": sarif}
    return forms[kind](findings)


def deliver(report: Report | str, path: str | None) -> None:
    """To a file, else to standard output."""
    if path is None:
        (print(report) if isinstance(report, str) else emit(report, sys.stdout))
        return
    with open(path, "w", encoding="utf-8") as out:
        (out.write(report) if isinstance(report, str) else emit(report, out))
