"""The training-data operators against brute force, and on odd rows."""

import hashlib
import html
import re
import sys
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamwright.llm import ann, common, components, html_templates, license_scan, line_crf, ngram_join, packing, raking, substring_dedup, toxic_spans, url_rules
from seamwright.llm.queries import tokenizer_file

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, token string, n string, path string, h string, weight string, prints string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash."""
    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(400)]
    long = " ".join(rng.choice(words, 30_000))
    base = " ".join(words[:120])
    near = base.replace("w7 ", "zz ")
    texts = [None, "", "  \n ", "one", "two words", base, base, near, near + " tail", long, "x " * 300, "ÀÉ ß\u0130 \u00a0 ok", base.upper(), "\n".join(["same line of text here"] * 9)]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t) if t else None, *["c"] * 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- shared pieces
def test_words_and_hashes():
    texts = [" a bb  ccc", "", None, "x", "\x1c y\x0bz\n", "Été A", "bb ccc"]
    for limit in (1, 8, 1000):
        seen = []
        for lo, hi, c in common.text_chunks(pa.array(texts), limit=limit):
            for d in range(hi - lo):
                a, b = c.first[d], c.first[d + 1]
                seen.append([c.data[s:e].tobytes().decode() for s, e in zip(c.starts[a:b], c.ends[a:b], strict=True)])
        assert seen == [words_of(t) for t in texts]
    (_, _, c), = common.text_chunks(pa.array(texts))
    pairs = common.window_hashes(c.word_hashes(), 2)
    assert pairs[1] == pairs[-1] and len(set(pairs[:-1].tolist())) == len(pairs) - 1
    assert common.inside(c.first, 2).sum() == 2 + 2 + 1 + 1


def test_components(spark):
    edges = [(1, 5), (5, 9), (9, 2), (7, 8), (8, 11), (11, 7), (20, 21), *[(30, k) for k in range(31, 60)]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {5: 1, 9: 1, 2: 1, 8: 7, 11: 7, 21: 20} | {k: 30 for k in range(31, 60)}
    assert {k: v for k, v in got.items() if k != v} == want


# ---------------------------------------------------------------- 1 packing
def test_plan_is_gapless_and_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    plan = packing.Plan(dict(Counter(lengths.tolist())))
    placed = defaultdict(list)
    for length, rank, n, sequence, offset in plan.slots:
        for i in range(n):
            placed[sequence + i].append((offset, length))
    assert sum(len(x) for x in placed.values()) == len(lengths)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(placed) <= 1.01 * -(-int(lengths.sum()) // 2048)
    assert packing.Plan({}).sequences == 0 and packing.Plan({2048: 3}).sequences == 3 and packing.Plan({1: 5000}).sequences == 3


def test_pieces_are_the_tokenizers(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    for frame in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = packing.pack(frame, tokenizer_file).collect()
        pieces = defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        for d in frame.collect():
            ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
            want = [(i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
            assert sorted(pieces[d.doc_id]) == want
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]


def test_special_tokens_and_scripts():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    tokenizer, fast = Tokenizer.from_file(path), packing.fast_tokens(path)
    for t in ("a <|endoftext|>b", "ΑΣ Σ ὈΔΥΣΣΕΎΣ", "İstanbul ß ẞ é", "漢字 テスト 😀", "don't I'LL \xa0\x1c ½ ² Ⅻ ١٢", "e\u0301 \u1e9e"):
        assert fast.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_remembered_pieces_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 200_000, raising=False)
    path = tokenizer_file()
    fast, rng = packing.FastTokens(path), np.random.default_rng(2)
    for _ in range(20):  # runs of letters without a space, one longer than all that may be kept
        text = " ".join("".join(map(chr, x)) for x in rng.integers(0x4E00, 0x9FA5, (30, 60))) + " " + "x" * 300_000
        assert fast.encode(text) == np.array(fast.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in fast.known.items()) <= 200_000
    assert fast.known


def test_pieces_of_many_partitions_are_written_to_few_files(spark, monkeypatch):
    written = []
    monkeypatch.setattr(packing, "materialize", lambda df, tag: written.append(out := common.materialize(df, tag)) or out)
    most = 2 * spark.sparkContext.defaultParallelism
    docs = spark.range(0, 300, 1, 30).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("word"), F.pmod("id", F.lit(7)).cast("int"))).alias("text"))
    out = packing.pack(docs, tokenizer_file(), 64)
    assert len(written[0].inputFiles()) <= most
    assert out.rdd.getNumPartitions() <= most
    assert sorted((r.doc_id, r.length) for r in out.collect()) == [(k, k % 7 + 1) for k in range(300)]


def test_every_code_point_is_split_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    tokenizer, fast = Tokenizer.from_file(path), packing.fast_tokens(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    points += ["\u1c89", "\ua7cb", "\U000323b0", "\u0378", "\ue000"]  # the first three came with later versions of Unicode
    texts = [f"a{c}b 1{c}" for c in points]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast.encode(text) == np.array(want.ids, "<u4").tobytes(), ascii(text)


# ---------------------------------------------------------------- 2 urls
def test_url_rules(spark):
    urls = [None, "", "no scheme/x", "http://A.Example.ORG/es/1?x#y", "http://example.org", "https://m.example.org/en/12", "x://b.com/fr/", "x://bcom/de/", "x://b.com/de/z", "p://h?q=/a", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "c", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, labels).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.org", "/es/1", "example.org/es/", "block"),
        4: ("example.org", "", None, "allow"), 5: ("m.example.org", "/en/12", "example.org/en/1", "block"), 6: ("b.com", "/fr/", "com/fr/", "allow"), 7: ("bcom", "/de/", None, "allow"),
        8: ("b.com", "/de/z", "com/de/", "block"), 9: ("h", "", None, "allow"), 10: ("b:", "//c/d", None, "allow"),
    }
    assert url_rules.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}.example.net/en/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(120))


def brute_rules(baskets):
    """All token sets with the share of bad among the urls that hold them, by enumeration."""
    from itertools import combinations

    n, bad = len(baskets), sum(b for _, b in baskets)
    sets = {frozenset(c) for tokens, b in baskets if b for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k)}
    found = {}
    for s in sets:
        held = [b for tokens, b in baskets if s <= tokens]
        hit, rest = sum(held), n - len(held)
        good_odds = hit * (rest - (bad - hit)) >= url_rules.MIN_ODDS * (len(held) - hit) * (bad - hit) and hit * (rest - (bad - hit)) > 0
        if hit / n >= url_rules.MIN_SUPPORT and hit / len(held) >= url_rules.MIN_CONFIDENCE and good_odds:
            found[s] = hit / len(held)
    return {s: c for s, c in found.items() if not any(o < s and found[o] >= c for o in found)}


@pytest.mark.parametrize("share", [0.2, 0.8])
def test_rules_are_those_of_enumeration(spark, share):
    rng = np.random.default_rng(int(share * 10))
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < share
        word = rng.choice(["spam", "win", "news"] if bad and rng.random() < 0.7 else ["news", "blog", "shop"])
        rows.append((i, f"http://{word}.example.net/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(['a', 'b'])}/{i}{rng.choice(['', '/', '.html', '?ref=x&a b=1'])}"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, "http://spam.example.net/en/x" + "/y" * 5000), (901, rows[7][1]), (902, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    host, path = url_rules.host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "url").withColumn("tokens", url_rules.tokens_of(F.col("host"), F.col("path"), F.col("url")))
    bad = {i: q == 0 for i, q, _ in labels}
    numbers = {r.page_id: re.search(r"/([0-9]+)(?:\.[A-Za-z]+)?/?$", r.path) for r in split.collect()}
    baskets = [(frozenset(r.tokens), bad[int(numbers[r.page_id][1])]) for r in split.collect() if numbers[r.page_id]]
    want = brute_rules(baskets)
    got = {frozenset(r.tokens): r.confidence for r in url_rules.mine(split.select("tokens", "path"), marks).collect()}
    assert set(got) == set(want) and all(got[s] == pytest.approx(c) for s, c in want.items()) and frozenset(["h:spam"]) in want
    verdicts = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, marks, rules=()).collect()}
    tokens = {r.page_id: set(r.tokens) for r in split.collect()}
    assert verdicts == {i: "block" if any(s <= t for s in want) else "allow" for i, t in tokens.items()}
    assert verdicts[900] == "block" and verdicts[902] == "allow" and "allow" in verdicts.values()


# ---------------------------------------------------------------- 3 html
def test_site_templates(spark):
    page = lambda i, h: f'<html><body><nav>menu</nav><div id="x{i}">Top of {h}</div><section><p>Story {i} &amp; more <b>bo</b>ld</p><p>two<br>lines {i}</p></section><div>Subscribe now</div><div class="comments">no</div></body></html>'
    rows = [(i, f"http://h{i % 2}.org/{i}", page(i, i % 2)) for i in range(20)] + [(90, None, None), (91, "x", ""), (92, "http://h0.org/1", "<p>a<p>b &lt;c"), (93, "q", "<article><p>keep</p><div class='ad'>no</div></article><p>out</p>")]
    rows.append(rows[0])
    pages = spark.createDataFrame([(*r, "c", "k") for r in rows], "page_id long, url string, html string, template string, key string")
    got = {r.page_id: r for r in html_templates.extract_text(pages).collect()}
    assert got[3].text == "Story 3 & more bold two lines 3" and got[3].n_chars == len(got[3].text)
    assert [got[k].text for k in (90, 91, 92, 93)] == ["", "", "a b <c", "keep"]
    assert html_templates.extract_text(pages.limit(0)).count() == 0


def test_templates_by_brute_force(spark):
    """Pages with and without an article, a notice of unknown class in each, and copies of one story."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(300)]
    story = lambda: [" ".join(rng.choice(words, 9)) for _ in range(3)]
    copied, rows, want = story(), [], {}
    for i in range(48):
        paragraphs = copied if i % 4 == 3 else story()
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        tag = "article" if i % 3 else "div"
        rows.append((i, f"http://h{i // 24}.org/{i}", f'<body><div class="zone{i}"><ul><li>Home {i // 24}<li>About</ul></div><{tag}><p class="x9">Our offer {i // 24} ends soon</p>{body}</{tag}><div>Imprint</div></body>'))
        want[i] = " ".join(paragraphs)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_templates.BROADCAST_TREES, 0):
        got = {r.page_id: r.text for r in html_templates.extract_text(pages, broadcast_trees=limit).collect()}
        assert got == want
    off = {r.page_id: r.text for r in html_templates.extract_text(pages, least=10**9).collect()}
    assert all(off[i] != want[i] for i in want)
    seen = defaultdict(set)
    for i, _, h in rows:
        page = html_templates.Page(h)
        for t in page.trees.values():
            seen[i // 24, t].add(page.key)
    all_of = [len({html_templates.Page(h).key for i, _, h in rows if i // 24 == k}) for k in (0, 1)]
    brute = {(k, t) for (k, t), p in seen.items() if len(p) >= 5 and len(p) >= (0.5 if t % 2 else 0.3) * all_of[k]}
    keyed = pages.select(F.lit("").alias("key"), F.xxhash64(F.regexp_extract("url", "//([^/]*)", 1)).alias("host"), "html")
    assert sorted(r.tree for r in html_templates.template_hashes(keyed).collect()) == sorted(t for _, t in brute)


def test_deep_and_long_pages_are_read_in_linear_time():
    import time

    began = time.time()
    assert html_templates.Page("<div>" * 50_000 + "x").text(()) == "x"
    assert html_templates.Page("<p>a<b>" * 30_000).text(()).count("a") == 30_000
    assert html_templates.Page("<article><section>" * 10_000 + "y" + "<div>z</div>" * 10_000).text(()).count("z") == 10_000
    assert time.time() - began < 20


def test_class_names_of_content_stay():
    page = '<article><div id="related-work"><p>kept</p></div><div class="share-buttons">gone</div><math><mi>x</mi></math></article>'
    assert html_templates.Page(page).text(()) == "kept x"


def test_comments_teasers_and_hidden_text():
    text = lambda body: html_templates.Page(f"<body>{body}</body>").text(())
    assert text('<article><p>Body text.</p><article class="comment"><p>Nice post!</p></article></article>') == "Body text."
    assert text("<h1>Title</h1><p>" + "A long story told here. " * 8 + '</p><div><article><a href="/x">Card</a></article></div>') == "Title " + ("A long story told here. " * 8).strip() + " Card"
    assert text("<article><p>The story</p></article><p>and a line</p>") == "The story"
    assert text('<article><p hidden>one</p><p aria-hidden="true">two</p><p style="display: none">three</p></article>') == "one two three"
    for name in ("user-comments", "commentlist", "site-footer-v2", "userComments", "post-comments", "ad-slot-3", "comment-thread", "sidebar right"):
        assert text(f'<article><p>kept</p><div class="{name}">gone</div></article>') == "kept", name
    for name in ("related-work", "entry-header", "post-footer", "comments-open", "has-sidebar", "content", "main", "headers-explained", "adventure"):
        assert text(f'<article><p>kept</p><div class="{name}">too</div></article>') == "kept too", name


def test_extraction_on_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_templates.extract_text(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))
        assert got[p.page_id] == re.sub(r"\s+", " ", html.unescape(body)).strip()


# ---------------------------------------------------------------- 4 licenses
def test_license_places(spark, odd):
    mit = license_scan.TEMPLATES["mit-grant"].split()
    noisy = " ".join([*mit[:20], "really", *mit[20:40], *mit[42:]])
    text = f"intro words {noisy} and then Released under the MIT License. end"
    frame = spark.createDataFrame([(1, text), (2, "Released under"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(frame).collect()}
    assert set(got) == {(1, "mit-grant"), (1, "mit-line")} and license_scan.scan_licenses(frame, {}).count() == 0
    r = got[1, "mit-grant"]
    assert r.word_start == 2 and text[r.char_start : r.char_end] == noisy and r.coverage == pytest.approx((len(mit) - 2) / len(mit))
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_alignments_by_brute_force():
    """Full local alignment of every template with texts that hold changed copies finds what the index and the band find."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(200)]
    index = license_scan.Index(license_scan.TEMPLATES)

    def whole(a, b):
        best, row = (0, 0), [(0, 0)] * (len(b) + 1)
        for x in a:
            new = [(0, 0)]
            for j, y in enumerate(b, 1):
                s, m = row[j - 1]
                new.append(max((0, 0), (s + 2, m + 1) if x == y else (s - 1, m), (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1])))
                best = max(best, new[-1])
            row = new
        return best[1]

    names = ["mit", "isc", "zlib", "apache-2.0-notice", "gpl-3-line", "unlicense"]
    for name in names:
        words = license_scan.TEMPLATES[name].split()
        for k in sorted(rng.choice(len(words), len(words) // 15, replace=False), reverse=True):  # words changed, lost and added
            words[k : k + 1] = [[], ["other"], [words[k], "more"]][int(rng.integers(3))]
        text = " ".join([*rng.choice(vocabulary, 60), *words, *rng.choice(vocabulary, 40)])
        hashes = license_scan._chunk(text).word_hashes()
        found = {}
        for n, coverage, a, b in license_scan.scan(index, hashes, 0.6):
            found[n] = max(found.get(n, 0), coverage)
            assert 0 <= a < b <= len(hashes)
        for t, n in enumerate(index.names):
            if len(index.words[t]) < 20 and n != name:  # of so short a line a changed copy may share no fingerprint
                continue
            coverage = whole(index.words[t], hashes.tolist()) / len(index.words[t])
            assert (n in found) == (coverage >= 0.6), (name, n, coverage)
            assert found.get(n, coverage) == pytest.approx(coverage, abs=0.03) or coverage < 0.6
        assert found[name] > 0.8


def test_places_that_cannot_match_are_not_aligned(monkeypatch):
    import time

    index = license_scan.Index(license_scan.TEMPLATES)
    began = time.time()
    assert license_scan.scan(index, license_scan._chunk("of the software and " * 50_000).word_hashes(), 0.6) == []
    assert time.time() - began < 5
    # nothing is lost by it
    rng = np.random.default_rng(4)
    vocabulary = [w for t in license_scan.TEMPLATES.values() for w in t.split()]
    names = sorted(license_scan.TEMPLATES, key=lambda n: len(license_scan.TEMPLATES[n]))[:6]
    for name in names:
        own = license_scan.TEMPLATES[name].split()[:300]
        edited = [w if rng.random() > 0.2 else str(rng.choice(vocabulary)) for w in own]
        text = " ".join([*rng.choice(vocabulary, 60), *edited, *rng.choice(vocabulary, 60), *own[: len(own) * 2 // 3]])
        words = license_scan._chunk(text).word_hashes()
        pruned = license_scan.scan(index, words, 0.6)
        with monkeypatch.context() as m:
            m.setattr(license_scan, "_possible", lambda bag, places, size, need: places)
            assert license_scan.scan(index, words, 0.6) == pruned


# ---------------------------------------------------------------- 5 n-gram join
def brute_classes(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_classes_of_near_copies(spark, size, percent):
    rng = np.random.default_rng(size)
    vocabulary = ["v%d" % k for k in range(3000)]
    rows = []
    for g in range(12):  # groups around a template, with one to six edits, some short, and a passage in common
        template = list(rng.choice(vocabulary, int(rng.integers(3, 150))))
        if g % 3 == 0:
            template += ["shared%d" % k for k in range(30)]
        for _ in range(14):
            copy = list(template)
            for _ in range(int(rng.integers(0, 7))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert got == brute_classes(rows, size, percent)


def test_counting_tokens_takes_no_more_memory_for_larger_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY_AT_ONCE", 1 << 16, raising=False)
    rng, most = np.random.default_rng(5), []
    for texts in (20, 100):
        batch = pa.record_batch([pa.array(["a b c d " + " ".join(map(str, rng.integers(0, 10**9, 20_000))) for _ in range(texts)])], ["text"])
        common.powers(common.CHUNK_BYTES + 1)
        tracemalloc.start()
        found = sum(sum(x["n"].to_pylist()) for x in ngram_join._heavy(4)(iter([batch])))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == texts  # the shingle that all texts share, counted in full
    assert most[1] < 1.1 * most[0]


def test_classes_of_odd_rows(spark, odd):
    got = ngram_join.jaccard_classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == 0 and by[1].component_id == 1
    assert {by[k].component_id for k in (5, 6, 7, 8, 12)} == {5} and by[3].n_shingles == 1 and by[4].component_id == 4
    assert ngram_join.jaccard_classes(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (5, text("b")), (7, text("c")), (7, text("c")), (None, text("c"))]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (5, 1), (7, 7), (7, 7), (None, None)], key=str) or got == sorted([(1, 1), (2, 1), (2, 1), (5, 1), (7, 7), (7, 7), (None, 7)], key=str)


# ---------------------------------------------------------------- 6 neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(20, size=600)] + rng.normal(size=(600, 16)) * 0.3, np.tile(centres[0], (30, 1))])
    rows = [(i, [float(v) for v in e], "c") for i, e in enumerate(x)] + [(1000, None, "c"), (1050, [0.0] * 16, "c"), (1100, [float("nan")] * 16, "c"), (1150, [None] * 16, "c"), (1200, [1.0, 2.0], "c"), (1250, [2.0, 4.0], "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rb string")
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    norm, hit = np.sqrt((x * x).sum(axis=1)), 0
    for q in range(0, 600, 50):
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        hit += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(s[v] == pytest.approx(c, abs=1e-15) for v, c in got[q])
    assert hit >= 0.9 * 60
    assert [v for v, _ in got[600]] == [601, 602, 603, 604, 605]
    assert [v for v, _ in got[1200]] == [1250] and not {1000, 1050, 1100, 1150} & set(got)
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_on_the_embeddings(spark):
    from seamwright.llm.queries import op6_multiprobe_neighbours

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    assert ann.fit_sample(unit, len(unit)).visit < 3 ** ann.HASHES[0]
    found = defaultdict(set)
    for r in op6_multiprobe_neighbours(spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        close = unit @ unit[q]
        close[q] = -2
        hit += len(found[int(ids[q])] & set(ids[np.argsort(-close)[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(found)


# ---------------------------------------------------------------- 7 quality
def test_base_counts(spark, docs, odd):
    crf = line_crf.train([])
    for frame in (docs, odd):
        for d, r in zip(frame.select("doc_id", "text").collect(), line_crf.line_quality(frame, crf).collect(), strict=True):
            text, w = d.text or "", words_of(d.text)
            seen, repeated = set(), 0
            for line in text.split("\n"):
                if words_of(line):
                    repeated += line in seen
                    seen.add(line)
            count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            covered = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
            assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_line_crf_tells_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = line_crf.line_quality(docs, line_crf.fit_line_crf(docs, train)).join(held, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.9 * len(rows)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(2)
    crf = line_crf.LineCrf(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    features = rng.integers(line_crf.N_FEATURES, size=(7, 12)).astype(np.int16)
    score = lambda s: crf.start[s[0]] + sum(crf.step[a, b] for a, b in zip(s, s[1:], strict=False)) + sum(crf.emit[f].sum() for f, y in zip(features, s, strict=True) if y)
    best = max(([int(b) for b in f"{k:07b}"] for k in range(128)), key=score)
    assert crf.viterbi(features, np.array([0, 7])).tolist() == best


# ---------------------------------------------------------------- 8 toxicity
def test_marginals_by_enumeration():
    crf = toxic_spans.TokenCrf(np.array(sorted(toxic_spans.slots_of("bad"))), np.full(4, 0.7), -1.0, np.array([[0.0, -0.5], [-0.3, 0.4]]))
    (_, _, chunk), = common.text_chunks(pa.array(["good bad ok bad"]))
    p = toxic_spans.Scorer(crf).marginals(chunk)
    e = [-1.0 + (2.8 if w == "bad" else 0) for w in "good bad ok bad".split()]
    total, mass = 0.0, np.zeros(4)
    for k in range(16):
        s = [int(b) for b in f"{k:04b}"]
        full = [0, *s, 0]
        x = np.exp(sum(crf.step[a, b] for a, b in zip(full, full[1:], strict=False)) + sum(v for v, y in zip(e, s, strict=True) if y))
        total += x
        mass += x * np.array(s)
    assert np.allclose(p, mass / total)


def test_toxic_words_are_found(spark, odd):
    rng = np.random.default_rng(4)
    plain = ["p%d" % k for k in range(200)]
    toxic, clean = [], []
    for _ in range(150):
        t = list(rng.choice(plain, 40))
        t[int(rng.integers(40))] = rng.choice(["grumbo", "snarklo,", "Grumbo"])
        toxic.append(t)
        clean.append(list(rng.choice(plain, 40)))
    rows = [(i, " ".join(t), i % 2) for i, t in enumerate(x for pair in zip(clean, toxic, strict=True) for x in pair)]
    rows += [rows[1]] * 40 + [(rows[3][0], "another text of one id", 1), (None, "grumbo", 1)]
    learnt, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    crf = toxic_spans.fit_token_crf(learnt.drop("toxic"), labels)
    frame = spark.createDataFrame([(1, "p1 p2 snarklo p3"), (2, "p1 p2 p3 p4"), (3, None), (4, " ".join(["p5"] * 400 + ["GRUMBO"] + ["p6"] * 400))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxic_spans.toxic_scores(frame, crf).collect()}
    assert got[1].score > 0.5 and got[4].score > 0.5 and got[2].score < 0.3 and got[3].score == 0
    assert [(s.start, s.end) for s in got[1].spans] == [(6, 13)]
    assert len(toxic_spans.toxic_scores(odd, crf).collect()) == odd.count()
    for none in (toxic_spans.train([]), toxic_spans.fit_token_crf(learnt.drop("toxic"), labels.where("toxic = 0")), toxic_spans.fit_token_crf(learnt.drop("toxic").limit(0), labels)):
        assert {r.score for r in toxic_spans.toxic_scores(frame, none).collect()} == {0.0}
    assert toxic_spans.toxic_scores(frame.limit(0), crf).count() == 0


def test_training_stretches_cover_the_whole_document():
    words = [f"c{k}" for k in range(20_000)]
    kinds = list(toxic_spans.stretches_of(words, False, {"w zz"}))
    assert len(kinds) == toxic_spans.DOC_STRETCHES and kinds[-1][1][-1] == words[-1] and not any(any(f) for *_, f in kinds)
    kinds = list(toxic_spans.stretches_of([*words, "zz"], True, {"w zz"}))
    assert [f for *_, f in kinds] == [[False] * 10 + [True]]


# ---------------------------------------------------------------- 9 mixing
def test_rake_fits_marginals(spark):
    rng = np.random.default_rng(6)
    cells = [(s, lang, t, float(rng.integers(1, 1000))) for s in ("a", "b", None) for lang in ("x", "y") for t in ("p", "q")]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    want = {"source": {"a": 0.5, "b": 0.3, None: 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.25, "q": 0.75}}
    targets = {d: spark.createDataFrame(list(v.items()), f"{d} string, share double") for d, v in want.items()}
    got = raking.rake(frame, targets, 12).collect()
    for d, shares in want.items():
        for level, share in shares.items():
            assert sum(r.weight for r in got if r[d] == level) == pytest.approx(share, abs=1e-3)


def test_worst_error_takes_few_jobs(spark):
    def jobs(name):
        spark.sparkContext.setJobGroup(name, name)
        spark.sparkContext.parallelize([0], 1).count()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    rng = np.random.default_rng(8)
    wants = [{k: float(x) for k, x in zip(["a", "b", "c", None], rng.random(4), strict=True)} | {"d": 0.0} for _ in raking.DIMENSIONS]
    levels = ["a", "b", "c", "d", "e", None]  # d wants nothing, e has no target
    rows = [(*[levels[k] for k in rng.integers(0, 6, 3)], float(rng.random())) for _ in range(200)]
    rows = [(*r, *[w.get(x) for w, x in zip(wants, r[:3], strict=True)]) for r in rows]
    names = [*raking.DIMENSIONS, "weight", *[f"want_{d}" for d in raking.DIMENSIONS]]
    fitted = common.materialize(spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n[0] == 'w' else 'string'}" for n in names)), "fitted")
    targets = {d: common.materialize(spark.createDataFrame(list(w.items()), f"{d} string, share double"), "want") for d, w in zip(raking.DIMENSIONS, wants, strict=True)}
    have = [Counter() for _ in wants]
    for r in rows:
        for k in range(3):
            have[k][r[k]] += r[3]
    # a null level is one of its own, as in rake
    expected = max(abs(have[k][x] / w[x] - 1) for k, w in enumerate(wants) for x in have[k] if w.get(x) and x is not None)
    nulls = max(abs(have[k][None] / w[None] - 1) for k, w in enumerate(wants))
    before = jobs("before")
    got = raking.worst_error(fitted, targets)
    used = jobs("after") - before - 1
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert abs(got - max(expected, nulls)) < 1e-9
    assert used <= 3


def test_every_row_gets_a_probability(spark, odd):
    rows = raking.calibrated(odd).collect()
    assert len(rows) == odd.count() and all(0 < r["__rake_p"] <= 1 for r in rows)


def test_sample_keeps_rows_and_share(spark, docs, odd):
    out = raking.rake_and_sample(docs, keep_share=0.7)
    assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
    tokens = lambda f: f.agg(F.sum(raking.tokens_of(F.col("text")))).first()[0]
    assert 0.5 < tokens(out) / tokens(docs) < 0.9
    kept = raking.rake_and_sample(odd, keep_share=1.0)
    assert kept.columns == odd.columns and kept.exceptAll(odd).isEmpty()
    assert raking.rake_and_sample(odd.limit(0)).count() == 0


def test_sample_has_the_target_shares(spark):
    text = F.when(F.col("id") % 20 == 0, "a | b | c d e").when(F.col("id") % 33 == 0, "licensed to be used so").otherwise("some words that are six")
    frame = spark.range(60_000).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.when(F.xxhash64("id") % 10 == 0, "few").when(F.xxhash64("id") % 7 == 0, None).otherwise("most").alias("source"), F.when(F.col("id") % 9 == 0, "de").otherwise("en").alias("lang")
    )
    given = {"source": {"most": 0.7, "few": 0.15, None: 0.15}, "lang": {"en": 0.8, "de": 0.2}, "topic": {"table": 0.1, "licence": 0.04, "note": 0.86}}
    targets = {d: spark.createDataFrame(list(v.items()), f"{d} string, share double") for d, v in given.items()}
    tokens = lambda f, d: {r[0]: r[1] for r in f.groupBy(d).agg(F.sum(raking.tokens_of(F.col("text")))).collect()}
    tagged = frame.withColumn("topic", raking.topic_of(F.col("text")))
    for wanted in (None, targets):
        out = common.materialize(raking.rake_and_sample(frame, targets=wanted).withColumn("topic", raking.topic_of(F.col("text"))), "sample")
        for d in raking.DIMENSIONS:
            own, got = tokens(tagged, d), tokens(out, d)
            want = given[d] if wanted else {k: v**raking.TEMPER / sum(x**raking.TEMPER for x in own.values()) for k, v in own.items()}
            for level, share in want.items():
                assert got[level] / sum(got.values()) == pytest.approx(share, abs=0.015)


# ---------------------------------------------------------------- 10 substrings
def brute_removed(rows):
    words = [w for _, t in rows for w in [(t or "").encode().split()]]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = bytearray(len(w))
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = b"\1" * 35
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_windows_go(spark, odd):
    rng = np.random.default_rng(8)
    vocabulary = ["u%d" % k for k in range(500)]
    passages = [list(rng.choice(vocabulary, n)) for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(60):
        w = list(rng.choice(vocabulary, int(rng.integers(0, 90))))
        for p in rng.integers(5, size=int(rng.integers(0, 3))):
            at = int(rng.integers(len(w) + 1))
            w[at:at] = passages[p]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " "), (3, rows[3][1])]
    for frame, want in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        out = substring_dedup.remove_repeats(frame)
        got = out.select("doc_id", "__sd_n_words", "__sd_n_removed", F.sha2("text", 256)).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_removed(want)
        assert out.columns[:-2] == frame.columns
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_log_knows_earlier_batches(spark):
    log = substring_dedup.FingerprintLog(spark, fanout=2)
    batch = lambda *x: spark.createDataFrame([(v,) for v in x], "print long")
    assert log.append(batch(1, 2, 3)).count() == 0
    assert {r[0] for r in log.append(batch(3, 4)).collect()} == {3}
    assert {r[0] for r in log.append(batch(4, 1, 9)).collect()} == {1, 4} and len(log.runs) == 1
    assert {r[0] for r in log.repeated().collect()} == {1, 3, 4}
    assert {(r[0], r[1]) for r in log.runs[0].collect()} == {(1, 2), (2, 1), (3, 2), (4, 2), (9, 1)}


def test_runs_are_merge_joined_without_a_shuffle(spark, capsys):
    log = substring_dedup.FingerprintLog(spark, fanout=4)
    for k in range(2):
        log.append(spark.range(k * 500, k * 500 + 1000).select(F.col("id").alias("print")))
    log.runs[0].hint("merge").join(log.runs[1], "print").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_lasting_log_gives_what_one_call_gives(spark, docs, tmp_path):
    mine = lambda out: sorted(tuple(r) for r in out.select("doc_id", "__sd_n_words", "__sd_n_removed", F.sha2("text", 256)).collect())
    frame = docs.select("doc_id", "text")
    parts = [frame.where(F.col("doc_id") % 3 == k) for k in range(3)]
    want = {r[0]: r for r in brute_removed([(r.doc_id, r.text) for r in frame.collect()])}
    last = None
    for part in parts:  # each call opens the log anew, as another session would
        log = substring_dedup.FingerprintLog(spark, f"file://{tmp_path}/log", fanout=2)
        last = mine(substring_dedup.remove_repeats(part, 2, log=log))
    assert log.version == 3 and len(log.runs) <= 2
    assert last == sorted(want[i] for i, *_ in last) and any(r[2] for r in last)
    alone = mine(substring_dedup.remove_repeats(parts[2], 2))
    assert alone != last


# ---------------------------------------------------------------- the pipeline
def test_pipeline_stages(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    now, sizes = docs, []
    for _, stage in pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, DATA), "t")
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = pipeline.STAGES[-1][1](spark, now, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_one_row_of_each_class_stays(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    rows = [(1, text("a"), "x"), (2, text("a"), "y"), (2, text("b"), "z"), (3, text("c"), "r"), (3, text("c"), "r"), (3, text("c"), "r"), (None, text("d"), None), (None, text("d"), None), (9, text("c") + " more", "q"), (10, None, "n"), (11, "", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, frame, DATA).collect()), key=str)
    a = [t for t in got if t[1] == text("a")]
    assert len(a) == 1 and [t for t in got if t[1] and t[1] != text("a")] == sorted([(2, text("b")), (3, text("c")), (None, text("d"))], key=str)
    assert {t for t in got if not t[1]} == {(10, None), (11, "")}


def test_stages_on_odd_rows(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    for frame in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, DATA)
            assert out.columns == frame.columns and out.select("doc_id", "lang").exceptAll(frame.select("doc_id", "lang")).isEmpty()
