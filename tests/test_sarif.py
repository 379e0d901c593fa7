"""SARIF logs written by tasks and read back."""

import json

import pytest
from pyspark.sql import functions as F

from seamwright.plans import report
from seamwright.sources import sarif

COLUMNS = "ord int, kind string, severity string, message string, file string, line int, column int"


def test_logs_hold_all_rows_in_order(spark, tmp_path):
    sarif.register(spark)
    kinds = ["missing-field", "type-mutation", "unresolved-route"]
    rows = [(k, kinds[k % 3], "note" if k % 3 == 2 else "error", f'line "{k}"\nsecond é', f"src/f{k % 7}.ts" if k % 11 else None, k + 1, k % 5) for k in range(500)]
    findings = spark.createDataFrame(rows, COLUMNS)
    placed = report.sarif_results(findings.repartition(6))
    folder = str(tmp_path / "logs")
    placed.write.format("sarif").mode("overwrite").save(folder)
    want = [(k, s, m, f, line, c) for o, k, s, m, f, line, c in sorted(rows, key=lambda r: r[0]) if f is not None]
    back = spark.read.format("sarif").load(folder)
    assert sorted(map(tuple, back.collect())) == sorted(want)
    index = json.loads((tmp_path / "logs" / "index.json").read_text())
    listed = []
    for name in index["logs"]:  # each is a log of its own, and together they are in order
        log = json.loads((tmp_path / "logs" / name).read_text())
        (run,) = log["runs"]
        assert log["version"] == "2.1.0" and {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
        listed += [r["message"]["text"] for r in run["results"]]
    assert listed == [w[2] for w in want]
    assert index["results"] == {r["rule_id"]: r["results"] for r in report.sarif_rules(findings).collect()} and index["rules"]["unresolved-route"] == "note"
    # more rows join the index, an overwrite replaces them
    placed.limit(3).withColumn("confidence", F.lit(0.5)).write.format("sarif").mode("append").save(folder)
    assert spark.read.format("sarif").load(folder).count() == len(want) + 3
    placed.limit(0).write.format("sarif").mode("overwrite").save(folder)
    assert spark.read.format("sarif").load(folder).count() == 0
    assert len([p for p in (tmp_path / "logs").iterdir() if p.suffix == ".sarif"]) == len(json.loads((tmp_path / "logs" / "index.json").read_text())["logs"])
    with pytest.raises(Exception, match="columns"):
        placed.drop("file").write.format("sarif").mode("append").save(folder)


def test_one_log_and_texts_are_streamed(spark):
    rows = [(k, "missing-field", "error", f"gone\n{k}", "a.ts", k, 1) for k in range(30)] + [(31, "unresolved-route", "note", "lost", None, None, None)]
    findings = spark.createDataFrame(rows, COLUMNS).repartition(5)
    (run,) = json.loads(report.written(report.sarif(findings)))["runs"]
    assert [r["message"]["text"] for r in run["results"]] == [f"gone\n{k}" for k in range(30)] and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["missing-field"]
    lines = report.written(report.text(findings)).splitlines()
    assert lines[0] == "ERROR   missing-field a.ts:0 gone 0" and lines[-1] == "31 findings" and len(lines) == 32
    assert [r["ord"] for r in json.loads(report.written(report.render(findings, "json")))] == [31, *range(30)]
    assert json.loads(report.written(report.render(findings.limit(0), "json"))) == []
    assert json.loads(report.written(report.sarif(findings.limit(0))))["runs"][0]["results"] == []
