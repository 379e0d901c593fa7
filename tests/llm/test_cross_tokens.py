"""Alignment of two tokenizers against brute force on whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seamwright.llm import cross_tokens
from seamwright.llm.queries import aligned_files

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = aligned_files()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=b)


def brute(rows, tokenizers):
    first, second = tokenizers
    letters = {i: t for t, i in cross_tokens.byte_level_tokens(aligned_files()[0]).items()}
    out, links = [], Counter()
    for doc, text in rows:
        body = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spans = []
        for ids, spell in ((a, letters.get), (b, lambda i: cross_tokens.piece_bytes(second.id_to_piece(i)))):
            parts = [spell(i) for i in ids]
            spans.append(np.cumsum([len(p) for p in parts]).tolist() if b"".join(parts) == body else None)
        if not text or None in spans:
            out.append([doc, 0, 0, 0, 0, [], ""])
            continue
        ends = sorted(set(spans[0]) & set(spans[1]))
        groups, i, j = [], 0, 0
        for end in ends:
            m, n = spans[0].index(end) + 1, spans[1].index(end) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        pairs = [(a[spans[0].index(e)], b[spans[1].index(e)]) for e in ends]
        links.update(pairs)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([doc, len(a), len(b), len(groups), len(pairs), pairs, hashlib.sha256(spelled.encode()).hexdigest()])
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return sorted((str((d, a, b, g, n, sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs), sha)) for d, a, b, g, n, pairs, sha in out))


def found(frame):
    got = cross_tokens.align_tokens(frame, aligned_files)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(str(tuple(r)) for r in got.collect())


def test_documents(spark, tokenizers):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    short = [r for r in rows if len(r[1] or "") < 20_000]
    assert found(spark.createDataFrame(short, "doc_id long, text string")) == brute(short, tokenizers)
    whole = {r.doc_id: r for r in cross_tokens.align_tokens(docs, aligned_files).collect()}
    assert len(whole) == len(rows)
    for doc, text in rows:
        assert whole[doc].n_a == len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids) if text else True


def test_odd_rows(spark, tokenizers):
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "two  spaces", "a\n\nb \n c\t\td ", "tab\tx y", "it's we'll I'D", "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score and more", "ends ▁", "é ÀÿŒ ß ½   x y　z", "漢字 テスト 😀 👩‍👩‍👧", "\x00 \x1c \x1d x\x1cy \x85 z", "1234567 89 0x1F", "x" * 3000, "ab " * 3000, "ﬁ ﬀ é ͸", "…—“q” (a),b;c", "same text here", "same text here"]
    texts += [f"{c}a{' ' * n}{d}" for n in (998, 999, 1000, 1001, 5000) for c in ("", " ") for d in ("", "b", "\n", "\nb", ".")] + ["\n" * 2000 + "x" + "\n \t" * 1000 + " y"]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("ab é\n\t '’漢😀▁ .1"), 40)) for _ in range(300)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, "ab x"), (3, "ab x"), (None, None)]
    frame = spark.createDataFrame([(d, t, "c", 1, "c") for d, t in rows], "doc_id long, text string, row string, n int, pairs string")
    assert found(frame) == brute(rows, tokenizers)
    assert found(frame.limit(0)) == []


def test_texts_are_cut_only_where_tokens_are(tokenizers):
    aligner = cross_tokens.Aligner(*aligned_files())
    assert aligner.chunked
    rng = np.random.default_rng(7)
    for _ in range(500):
        text = "".join(rng.choice(list("the of wo  rd.,\n"), 60)) or "x"
        whole, parts = aligner.numbers([text])[0], []
        aligner.chunked = False
        one = aligner.numbers([text])[0]
        aligner.chunked = True
        parts = ";".join(aligner.groups[k] for k in whole)
        assert parts == aligner.groups[one[0]]


def test_components_and_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        x, y = rng.integers(0, n, 40), rng.integers(0, n, 40)
        least = list(range(n))
        for _ in range(n):
            for a, b in zip(x, y, strict=True):
                least[a] = least[b] = min(least[a], least[b])
        assert cross_tokens.components(n, x, y).tolist() == least
    assert cross_tokens.pair_bound([b"ab", b"b", b"c"], [b"b", b"ab", b"xab", b"b"]) == 8
    aligner = cross_tokens.Aligner(*aligned_files())
    assert cross_tokens.pair_bound(list(aligner.a.values()), aligner.b) < 500_000


def test_very_wide_white_space():
    aligner = cross_tokens.Aligner(*aligned_files())
    for text in (" " * 1_000_000 + "x", "\n" * 300_000):
        (number,), = aligner.numbers([text])
        assert aligner.groups[number] is not None and aligner.n_groups.data[number] > 1
