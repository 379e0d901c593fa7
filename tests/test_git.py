"""Files of a git revision against those of a checkout."""

import subprocess

from seamwright.plans import baseline
from seamwright.sources import git
from seamwright.sources.files import read_files


def test_revision_equals_checkout(spark, tmp_path):
    repo = tmp_path / "repo"
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    files = {f"app/m{k % 7}/f{k}.{'ts' if k % 2 else 'py'}": f"// file {k}\n" * (k * 3) for k in range(60)}
    files |= {"app/tsconfig.json": "{}", "app/tsconfig.base.json": "{}", "app/package.json": "{}", "app/node_modules/x.ts": "no", "app/.hidden/y.ts": "no", "app/empty.go": "", "app/ümlaut é.ts": "ü", "app/last line": "x", "other/z.ts": "z"}
    for path, text in files.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    run("init", "-q")
    run("add", "-f", ".")
    run("commit", "-qm", "first")
    (repo / "app" / "empty.go").write_text("changed later")
    subprocess.run(["git", "clone", "-q", str(repo), str(tmp_path / "copy")], check=True, capture_output=True)
    rows = lambda df: sorted((r.path, r.lang, r.text) for r in df.collect() if r.text)  # noqa: E731  binaryFile leaves out empty files
    want = rows(read_files(spark, str(tmp_path / "copy" / "app")))
    assert rows(baseline.files_of(spark, "HEAD", repo / "app", repo)) == want and len(want) == 62
    many = spark.read.format("git_files").options(repository=str(repo), revision="HEAD", folder="app", share="300").load()
    assert many.rdd.getNumPartitions() > 20 and rows(many) == want
    assert rows(baseline.files_of(spark, "HEAD", repo, repo))[-1] == ("other/z.ts", "ts", "z")
    for empty in ("EMPTY", "0" * 40):
        assert baseline.files_of(spark, empty, repo, repo).count() == 0
    assert git.kept("a/dist/b.ts") is None and git.kept("x.gql") == "graphql"
