"""Line dedup against brute force on odd rows."""

from collections import defaultdict

from seamwright.llm import line_dedup

COLUMNS = "doc_id long, text string, line string, lines string, n long, gone string, position string, k_id string"


def brute(rows, least):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add(("id", doc) if doc is not None else ("row", k))
    common = {x for x, who in holders.items() if x and len(who) >= least}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in common]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_on_odd_rows(spark):
    shared = ["  Read More\t", "read more", "READ MORE\x0b", "\x1cread more", "\xa0read more", "ÉTÉ", "été", "", " ", "tail"]
    texts = [None, "", "\n", "\n\n", "one\ntwo", *["\n".join(shared[k % 10 :] + [f"own {k}", "Read more", "x"]) for k in range(12)], "x\n" * 3000, "long " * 40_000 + "\nx\nlast", "x"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(7, texts[7])] * 3 + [(8, "x\nother text of one id"), (None, "tail\nx"), (None, "tail\nx"), (None, None)] + [(900, "only here\nten rows of one id")] * 12
    frame = spark.createDataFrame([(d, t, *["c"] * 2, 1, *["c"] * 3) for d, t in rows], COLUMNS)
    for least in (1, 3, 10):
        got = line_dedup.drop_common_lines(frame, least)
        assert got.columns == [*frame.columns, "__ld_n_lines", "__ld_n_dropped"]
        found = [(r.doc_id, r.text, r["__ld_n_lines"], r["__ld_n_dropped"]) for r in got.collect()]
        assert sorted(found, key=str) == sorted(brute(rows, least), key=str)
        assert {r.line for r in got.collect()} == {"c"}


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_common_lines(frame).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 11, "doc_id long, text string")
    assert {(r.text, r["__ld_n_lines"], r["__ld_n_dropped"]) for r in line_dedup.drop_common_lines(nulls).collect()} == {("", 1, 0)}
