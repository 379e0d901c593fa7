"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamwright.llm import spelling


def words_of(rows, least=spelling.LETTERS, times=spelling.TIMES, slip=spelling.SLIP):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=spelling.RATIO):
    form, out = {}, {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if abs(len(x) - len(w)) < 2 and x != w and near(w, x))
        if close and -close[0][0] >= ratio * n:
            form[w] = close[0][1]
        out[w] = len(close)
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, form.get(w) or "", root(w), n, out[w], words[form[w]] if w in form else -1) for w, n in words.items())


def plain(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in frame.collect())


def test_wavelet_tree_reports_ranges():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        bounds = [np.sort(rng.integers(0, n + 1, (40, 2)), axis=1) for _ in range(2)]
        query, value = tree.report(bounds[0][:, 0], bounds[0][:, 1], bounds[1][:, 0], bounds[1][:, 1])
        want = [(q, v) for q in range(40) for v in values[bounds[0][q, 0] : bounds[0][q, 1]] if bounds[1][q, 0] <= v < bounds[1][q, 1]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted((q, int(v)) for q, v in want)


@pytest.mark.parametrize("group", [2, 30, 50_000])
def test_near_words(spark, group):
    """Runs of equal letters, letters at either end of Latin-1, keys that have to be split down to one open letter."""
    rng = np.random.default_rng(group)
    words = {"".join(rng.choice(list("abÿ"), int(n))) for n in rng.integers(1, 9, 900)} | {"a" * n for n in range(1, 40)} | {"a" * 30 + x for x in ("b", "ba", "ÿ", "b" * 5)} | {"x" * 9 + c for c in "abcdefghijklmnopqrstuvwxyzà"}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.integers(1, 200, len(words)), strict=True)}
    got = {r.word: (r.n_near, r.top.form) for r in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), group, 500).collect()}
    want = {}
    for w in words:
        close = sorted((-counts[x], x) for x in words if abs(len(x) - len(w)) < 2 and x != w and near(w, x))
        if close:
            want[w] = (len(close), close[0][1])
    assert got == want


def test_forms_on_odd_rows(spark):
    base = ["information", "informations", "ΑΒΓinformationΔ", "übergröße", "UBERGROSSE", "ÀÉÎõü×÷ÿ", "aaaaaaa", "aaaaaaaa", "short", "sixsix", "sevenly"]
    rows = [(k, " ".join(base[: k % len(base)] * (k % 5)) + f" information{k % 3}x informatoin") for k in range(120)]
    rows += [(None, None), (None, "information, informatiom"), (5, ""), (5, "\n"), (6, "information " * 400), (7, "i" * 20_000 + " " + "i" * 20_000), (7, "i" * 20_001), (8, "i" * 20_001), *[(9, "informtion")] * 6]
    frame = spark.createDataFrame([(d, t, "c", "c", 1) for d, t in rows], "doc_id long, text string, word string, form string, n long")
    for slip in (31, 3):
        words = words_of(rows, slip=slip)
        assert plain(spelling.spelling_forms(frame, slip=slip, group=20, bucket=50)) == brute(words)
    assert any(r.form for r in spelling.spelling_forms(frame).where(F.col("form").isNotNull()).collect())
    assert plain(spelling.spelling_forms(frame.limit(0))) == []


def test_roots_follow_chains(spark):
    texts = [("wordone ", 2), ("wordonee ", 25), ("wordoneee ", 300)]
    frame = spark.createDataFrame([(k, w * n) for k, (w, n) in enumerate(texts)], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_forms(frame, slip=1 << 40).collect()}
    assert got == {"wordone": ("wordonee", "wordoneee"), "wordonee": ("wordoneee", "wordoneee"), "wordoneee": (None, "wordoneee")}
