import pytest
from pyspark.sql import functions as F

from seamwright.operators import repair
from seamwright.sources import files


def test_renames_reads_only():
    text = 'const { email, name: n } = res; show(res.email, res?.email, res["email"]); res.email = 1; if (res.email == 2) go(); // res.email\n'
    assert repair.rename_in_source(text, "email", "mail") == 'const { mail: email, name: n } = res; show(res.mail, res?.mail, res["mail"]); res.email = 1; if (res.email == 2) go(); // res.email\n'.replace("if (res.email == 2)", "if (res.mail == 2)")


def test_optional_chains():
    assert repair.optional_chain_in_source("a.age.toFixed(0); a.age[1]; a.age(); a.age?.x; f(a.age);", "age") == "a.age?.toFixed(0); a.age?.[1]; a.age?.(); a.age?.x; f(a.age);"


def test_repair_by_file(spark):
    f = files.in_memory(spark, {"a.ts": "x(r.email)", "b.ts": "y(r.email)", "c.ts": "z()", "d.ts": "w(r.email)"})
    impacts = spark.createDataFrame([("a.ts", "BREAKING", True, 100.0, 1), ("b.ts", "BREAKING", True, 60.0, 1), ("c.ts", "BREAKING", True, 90.0, 1)], "path string, severity string, field_level_match boolean, confidence double, ord int")
    got = {r.path: (r.text, r.status) for r in repair.repair_files(f, impacts, "rename-field", "email", "mail").collect()}
    assert got == {"a.ts": ("x(r.mail)", "patched"), "b.ts": ("y(r.email)", "skipped: not certain enough"), "c.ts": ("z()", "skipped: nothing to edit"), "d.ts": ("w(r.email)", None)}
    with pytest.raises(ValueError):
        repair.repair_files(f, impacts, "other", "a")


def test_verdicts(spark):
    plain = (False, True, None, None)
    rows = [(*plain, 1, 0, 0, 0, 0, "FAIL"), (*plain, 0, 2, 0, 0, 0, "REVIEW_REQUIRED"), (*plain, 0, 0, 0, 0, 0, "PASS")]
    rows += [(True, False, s, s, 0, 0, 0, 0, 0, w) for s, w in (("COMPLETE", "PASS"), ("INCOMPLETE", "REVIEW_REQUIRED"))]
    rows += [(True, True, b, a, 1, 0, n, still, p, w) for b, a, n, still, p, w in (("UNVERIFIED", "COMPLETE", 0, 0, 1, "FAIL"), ("INCOMPLETE", "COMPLETE", 0, 0, 1, "PROVEN"), ("COMPLETE", "COMPLETE", 0, 0, 0, "PASS"), ("INCOMPLETE", "INCOMPLETE", 0, 0, 0, "FAIL"), ("INCOMPLETE", "INCOMPLETE", 0, 0, 1, "REVIEW_REQUIRED"), ("INCOMPLETE", "COMPLETE", 1, 0, 1, "FAIL"), ("INCOMPLETE", "COMPLETE", 0, 1, 1, "FAIL"))]
    df = spark.createDataFrame(rows, "i boolean, r boolean, b string, a string, x int, u int, n int, s int, p int, want string")
    got = df.select(repair.receipt_verdict(*[F.col(k) for k in ("i", "r", "b", "a", "x", "u", "n", "s", "p")]).alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]
