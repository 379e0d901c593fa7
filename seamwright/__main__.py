"""python -m seamwright check CLIENT SERVER | validate CLIENT SERVER | impact, agent-check, fix or receipt CLIENT BASE SERVER

BASE is a folder with the server as it was, or git:REVISION for that revision of SERVER.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import impact, intent, matching, repair
from .plans import baseline, config, report
from .plans.check import check_trees, graph_faults, place_of, snapshot_changes, snapshot_impacts
from .plans.receipt import build_receipt, verify
from .plans.scratch import cut
from .sources.files import parse_errors, read_files

FORMATS = ("text", "json", "markdown", "sarif")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="seamwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("check", "compare the calls of a client tree with the handlers of a server tree"), ("validate", "check the graph of both trees for faults")):
        one = commands.add_parser(name, help=text)
        one.add_argument("client", nargs="?")
        one.add_argument("server", nargs="?")
        one.add_argument("--strict", action="store_true")
        one.add_argument("--format", choices=FORMATS if name == "check" else ("text", "json"), default="text")
    for name, text in (("impact", "what the changes between two server trees do to a client tree"), ("agent-check", "is a stated change carried out?"), ("fix", "patch the consumers of a stated change"), ("receipt", "prove a repair by analysing the patched client again")):
        one = commands.add_parser(name, help=text)
        for place in ("client", "base", "server"):
            one.add_argument(place)
        one.add_argument("--rename")
        one.add_argument("--widen-optional")
        one.add_argument("--apply", action="store_true")
        one.add_argument("--format", choices=FORMATS if name == "impact" else ("text", "json"), default="json")
    for one in commands.choices.values():
        one.add_argument("--threshold", type=float, default=matching.THRESHOLD)
        one.add_argument("--out")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if not 0 <= args.threshold <= 1:
        parser.error("--threshold must be between 0 and 1")
    settings = config.load(".")
    spark = spark or SparkSession.builder.appName("seamwright").getOrCreate()
    text, code = (_trees if args.command in ("check", "validate") else _snapshots)(args, settings, spark, parser)
    report.deliver(text, args.out)
    return code


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return read_files(spark, str(Path(folder).resolve()))


def _trees(args: argparse.Namespace, settings: config.Config, spark: SparkSession, parser: argparse.ArgumentParser) -> tuple[report.Report | str, int]:
    """H15, H17."""
    roots = config.project_roots(".") or (None, None)
    client, server = args.client or settings.client or roots[0], args.server or settings.server or roots[1]
    if not client or not server:
        parser.error("client and server folders are needed")
    trees = _read(spark, client), _read(spark, server)
    for tree in trees:
        for r in parse_errors(tree).toLocalIterator():
            print(f"seamwright: {r.path} could not be read: {r.error}", file=sys.stderr)
    if args.command == "validate":
        faults = cut(graph_faults(*trees, args.threshold))
        text = report.json_rows(faults, "severity", "code", "subject") if args.format == "json" else report.validation_text(faults)
        return text, int(not faults.where("severity = 'error'").isEmpty() or (args.strict and not faults.isEmpty()))
    found = cut(check_trees(*trees, args.threshold))
    return report.render(found, args.format), int(not found.where("severity = 'error'").isEmpty())


def _snapshots(args: argparse.Namespace, settings: config.Config, spark: SparkSession, parser: argparse.ArgumentParser) -> tuple[report.Report | str, int]:
    """H14, H16, H18."""
    if args.rename and args.widen_optional:
        parser.error("--rename and --widen-optional exclude each other")
    stated = intent.parse_rename(args.rename) if args.rename else intent.parse_widen(args.widen_optional) if args.widen_optional else None
    if stated is None and args.command in ("agent-check", "fix"):
        parser.error(f"{args.command} needs --rename or --widen-optional")
    client, server = _read(spark, args.client), _read(spark, args.server)
    base = baseline.files_of(spark, args.base[4:], args.server) if args.base.startswith("git:") else _read(spark, args.base)
    base_client = baseline.files_of(spark, args.base[4:], args.client) if args.base.startswith("git:") else None
    if args.command == "receipt":
        return _receipt(args, stated, client, base, server, base_client)
    handlers = snapshot_changes(base, server)
    rows = cut(snapshot_impacts(handlers[2], client, *handlers[:2], base_client, args.threshold))
    counts = impact.summarize(rows).withColumns({"tier": F.lit(None).cast("string"), "is_public": F.lit(False), "environment": F.lit(None).cast("string")})
    summary = impact.risk(counts, settings.risk).first().asDict()
    facts = {k: F.lit(None).cast(t) for k, t in (("kind", "string"), ("flag", "string"), ("status", "string"), ("applied", "boolean"), ("patches", "int"), ("skipped", "int"), ("skip_reasons", "array<string>"))}
    mine = rows
    if stated:
        mine = rows.where(F.col("contract_id") == stated["contract_id"])
        old, new = stated.get("from", stated.get("field")), stated.get("to", "")
        facts |= {"kind": F.lit(stated["kind"]), "flag": intent.intent_flag(*[F.lit(x) for x in (stated["kind"], stated["contract_id"], old, new)])}
    extra: dict = {}
    if args.command == "agent-check":
        status = verify(stated, handlers[2], rows).first()
        facts["status"] = F.lit(status["status"])
        extra = {"status": status["status"]}
    if args.command == "fix":
        placed = mine.select(place_of(F.col("consumer_id"))["path"].alias("path"), "severity", "field_level_match", "confidence", F.xxhash64("consumer_id").alias("ord"))
        done = cut(repair.repair_files(client, placed, stated["kind"], old.rsplit(".", 1)[-1], new.rsplit(".", 1)[-1]).where("status is not null"))
        patched, skipped = done.where("status = 'patched'"), [f"{r.path}: {r.status}" for r in done.where("status <> 'patched'").select("path", "status").orderBy("path").toLocalIterator()]
        paths = [r.path for r in patched.select("path").orderBy("path").toLocalIterator()]
        if args.apply:
            _write(args.client, patched)
        facts |= {"applied": F.lit(args.apply and bool(paths)), "patches": F.lit(len(paths)), "skipped": F.lit(len(skipped)), "skip_reasons": F.array(*[F.lit(s) for s in skipped]).cast("array<string>")}
        extra = {"patched": paths, "skipped": skipped}
    n = intent.counts(mine)
    hint = mine.select(F.lower("severity").alias("key"), place_of(F.col("consumer_id"))["path"].alias("hint")).distinct().withColumn("ord", F.xxhash64("hint"))
    hints = {r["key"]: r["hints"] for r in intent.hints(hint).collect()}
    told = intent.agent_summary(n.withColumns({**{f"{k}_files": F.lit(hints.get(k, "")) for k in ("breaking", "warning", "unknown")}, **facts})).first()
    if args.format == "sarif":
        text = report.impact_sarif(rows, summary)
    elif args.format == "markdown":
        text = report.impact_markdown(rows, summary, told["summary_verdict"], told["next_actions"])
    else:
        whole = {"summary": summary, "verdict": told["summary_verdict"], "repair_available": told["repair_available"], "next_actions": told["next_actions"], **extra}
        text = json.dumps(whole, indent=2) if args.format == "json" else "\n".join([f"{told['summary_verdict']}: {n.first().asDict()}", *[f"NEXT: {a}" for a in told["next_actions"]]])
        if args.format == "json" and args.command == "impact":
            listed = report.json_rows(rows, "contract_id", "consumer_id")
            text = listed._replace(head=text.removesuffix("\n}") + ',\n  "impacts": ' + listed.head, tail="\n]}\n")
    code = {"impact": summary["breaking"] > 0, "agent-check": extra.get("status") != "COMPLETE", "fix": bool(extra.get("skipped")) and not extra.get("patched")}[args.command]
    return text, int(code)


def _write(folder: str, patched: DataFrame) -> None:
    for r in patched.select("path", "text").toLocalIterator():
        Path(folder, r.path).write_text(r.text)


def _receipt(args: argparse.Namespace, stated: dict[str, str] | None, client: DataFrame, base: DataFrame, server: DataFrame, base_client: DataFrame | None) -> tuple[str, int]:
    made = build_receipt(client, base, server, stated, base_client, args.threshold)
    row = made.summary.first().asDict()
    if args.apply and row["verdict"] == "PROVEN":
        _write(args.client, made.files.where("status = 'patched'"))
    elif args.apply:
        print(f"seamwright: nothing is applied, as the verdict is {row['verdict']}", file=sys.stderr)
    whole = {**row, "intent": stated, "files": [r.asDict() for r in made.files.select("path", "status").orderBy("path").toLocalIterator()], "consumers": [r.asDict() for r in made.consumers.orderBy("state", "key").toLocalIterator()]}
    text = json.dumps(whole, indent=2) if args.format == "json" else "\n".join(f"{k}: {v}" for k, v in whole.items())
    return text, int(row["verdict"] not in ("PROVEN", "PASS"))


if __name__ == "__main__":
    sys.exit(main())
