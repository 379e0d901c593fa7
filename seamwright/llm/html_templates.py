"""HTML extraction: subtrees that recur across the pages of a host are its template and go.

Every page is parsed into blocks of text and its element subtrees are hashed bottom-up, by tags and text alone, each once. Spark
counts for each host on how many distinct pages a hash occurs; pages with the same three longest blocks count as one,
so that copies of an article are no template. A subtree found on TEMPLATE_PAGES distinct pages of a host or more is
deleted if these are a share of OUTSIDE of the host's pages, within articles INSIDE. An article or main element, and what
holds one, is never template as a whole. Counts are pre-aggregated by (host, hash, page), so a hot host is no heavier per task.
Elements that are no content on any page (menus, forms, adverts, comments, scripts) go by tag, role or class, so
that hosts of one page are served too; a class names such an element if its last word does, apart from words for boxes
(`user-comments`, `site-footer-v2`). What is left of the articles is the text if it is a share of ARTICLE of what is left of the main
element, or of the body if there is none; else the page's articles are only teasers, and all of that is the text.

The hashes to delete are sent to all tasks if they number BROADCAST_TREES at most; more are joined to the pages. Results are the same.

Null html is empty; a page without content has an empty text. Repeated rows give equal
texts. Unclosed and stray tags are repaired as browsers do in the common cases. A null or odd url counts for the
host ''. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Container, Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

TEMPLATE_PAGES, OUTSIDE, INSIDE = 5, 0.3, 0.5
ARTICLE = 0.25
BROADCAST_TREES = 200_000

# Element names of the HTML standard, by their role here.
_RAW = "script|style|noscript|template|textarea|title|iframe|canvas|audio|video"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav aside form button select option dialog menu head footer".split())
_P_ENDS = frozenset(_BLOCK - {"br", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"})
_SELF_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion reaction recommended related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words that only say what kind of box a class names.
_BOXES = frozenset("area bar block body bottom box boxes button buttons col column container content form group holder icons inline inner item items left link links list main menu outer panel right row section site slot thread top tree unit wrap wrapper".split())
# Parts of an article that a heading or closing belongs to, and words that turn a name into a remark on the page.
_PARTS, _REMARKS = frozenset("article entry post story title".split()), frozenset("has is no with without hide show".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_BLANK = re.compile(r"\s+")


def _split(word: str) -> list[str]:
    """`commentlist` as its two words, if both are known; others as they are."""
    for k in range(2, len(word) - 1):
        if word[:k] in _WORDS and word[k:] in _WORDS | _BOXES:
            return [word[:k], word[k:]]
    return [word]


@lru_cache(maxsize=4096)
def _is_furniture(name: str) -> bool:
    """Is the last word of a class or id that isn't a box or a number a word for furniture? `related-work`'s isn't, `share-buttons`'s is."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower()
    words = [w for word in _WORD.findall(spaced) for w in ([word] if word in _WORDS | _BOXES else _split(word)) if not re.fullmatch(r"v?\d+", w)]
    if not words or words[0] in _REMARKS:
        return False
    if _WORDS.isdisjoint(words):
        return False
    while words[-1] in _BOXES - _WORDS:
        words.pop()
        if not words:
            return False
    # an article's own header and footer hold its title and author
    return words[-1] in _WORDS and not (words[-1] in ("header", "footer", "masthead") and not _PARTS.isdisjoint(words))


def _no_content(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not inside_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and any(_is_furniture(v) for v in value.split()):
            return True
        if name == "role" and value.strip().lower() in _ROLES:
            return True
    return False


class _Node:
    __slots__ = ("article", "block", "gone", "has_text", "holds", "main", "number", "parts", "tag")

    def __init__(self, tag: str, above: _Node | None, gone: bool, article: bool, main: bool, number: int):
        self.tag, self.gone, self.article, self.main, self.number = tag, gone, article, main, number
        self.holds = self.has_text = False
        self.block = above is None or tag in _BLOCK
        # what a subtree's hash is made of is gathered by the nearest block
        self.parts: list[bytes] = [] if self.block else above.parts


class Page:
    """Blocks of a page in order, and its element subtrees that might be template.

    blocks: (text, within an article, within main, number of its subtree); parent: number of the subtree around each;
    trees: number -> hash, odd if within an article; key: hash of the three longest blocks.
    """

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, bool, bool, int]] = []
        self.trees: dict[int, int] = {}
        self.parent = [0]
        html = html or ""
        stack = [_Node("", None, False, False, False, 0)]
        open_tags: defaultdict[str, list[int]] = defaultdict(list)  # tag -> places on the stack
        open_blocks = [0]
        texts: list[str] = []

        def flush() -> None:
            if texts:
                text = _BLANK.sub(" ", unescape("".join(texts))).strip()
                texts.clear()
                top = stack[-1]
                if text:
                    top.parts.append(text.encode("utf-8", "replace"))
                    stack[open_blocks[-1]].has_text = True
                    if not top.gone:
                        self.blocks.append((text, top.article, top.main, top.number))

        def pop() -> None:
            node = stack.pop()
            open_tags[node.tag].pop()
            if not node.block:
                return
            open_blocks.pop()
            digest = blake2b(b"\0".join([node.tag.encode(), *node.parts]), digest_size=8).digest()
            above = stack[open_blocks[-1]]
            above.parts.append(digest)
            above.has_text |= node.has_text
            if node.has_text and not node.gone and not node.holds and node.tag not in ("html", "body", "head", "article", "main"):
                self.trees[node.number] = int.from_bytes(digest, "little", signed=True) & ~1 | node.article

        def pop_to(k: int) -> None:
            flush()
            while len(stack) > k:
                pop()

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                texts.append(html[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _BLOCK:
                flush()
            if m[2]:  # an end tag
                k = open_tags[tag][-1] if open_tags[tag] else 0
                if k and not (stack[-1].article and tag not in ("article", "main", "body", "html") and not stack[k].article):
                    if tag not in _BLOCK and open_blocks[-1] > k:
                        continue
                    if tag in _BLOCK:
                        pop_to(k)
                    else:
                        while len(stack) > k:
                            pop()
                continue
            if tag in _VOID:
                continue
            if tag in _P_ENDS and open_tags["p"]:
                k = open_tags["p"][-1]
                if not any(open_tags[t] and open_tags[t][-1] > k for t in ("article", "section", "div", "td", "li")):
                    pop_to(k)
            ends = _SELF_ENDS.get(tag)
            if ends and stack[open_blocks[-1]].tag in ends:
                pop_to(open_blocks[-1])
            top = stack[-1]
            article, main = top.article or tag == "article", top.main or tag == "main" or 'role="main"' in m[4]
            gone = top.gone or _no_content(tag, m[4], top.article)
            if (tag == "article" or (main and not top.main)) and not gone:
                for n in reversed(stack):
                    if n.holds:
                        break
                    n.holds = True
            if m[4].endswith("/") and tag not in _BLOCK:
                continue
            self.parent.append(top.number)
            node = _Node(tag, top, gone, article and not gone, main and not gone, len(self.parent) - 1)
            open_tags[tag].append(len(stack))
            if node.block:
                open_blocks.append(len(stack))
            else:
                node.parts.append(tag.encode())
            stack.append(node)
        if at < len(html):
            tail = html[at:]
            cut = tail.rfind("<")
            if cut >= 0 and ">" not in tail[cut:] and re.match(r"</?[a-zA-Z]", tail[cut:]):
                tail = tail[:cut]
            texts.append(tail)
        pop_to(1)

    @property
    def key(self) -> int:
        longest = sorted(self.blocks, key=lambda b: -len(b[0]))[:3]
        return int.from_bytes(blake2b("\0".join([b[0] for b in longest]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def text(self, template: Container[int]) -> str:
        """The content, without subtrees whose hash is in template."""
        gone = [False] * len(self.parent)
        for n in range(1, len(self.parent)):  # a subtree has a larger number than the one around it
            gone[n] = gone[self.parent[n]] or (n in self.trees and self.trees[n] in template)
        left = [b for b in self.blocks if not gone[b[3]]]
        around = [b for b in left if b[2]] if any(b[2] for b in self.blocks) else left
        # an article may stand beside a main element, too
        article = [b for b in left if b[1]]
        size = lambda blocks: sum(len(b[0]) for b in blocks)
        chosen = article if any(b[1] for b in self.blocks) and size(article) >= ARTICLE * size(around) else around
        return " ".join([b[0] for b in chosen])


#: A page itself, among the hashes of its subtrees.
_WHOLE = 0


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, host, html: hashes of each page's subtrees and of its longest blocks."""
    for batch in batches:
        pages = [Page(h) for h in batch.column(2).to_pylist()]
        trees = [[_WHOLE, *sorted(set(p.trees.values()))] for p in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.key for p in pages], pa.int64()), pa.array(trees, pa.list_(pa.int64()))], ["key", "host", "page", "trees"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """html as compressed bytes and their size: it crosses the shuffle at less than half the length."""
    kinds = pa.binary(), pa.int32()
    for batch in batches:
        raw = [None if h is None else h.encode() for h in batch.column(3).to_pylist()]
        packed = [None if r is None else pa.compress(r, codec="zstd", asbytes=True) for r in raw]
        size = [0 if r is None else len(r) for r in raw]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(packed, kinds[0]), pa.array(size, kinds[1])], ["page_id", "url", "key", "packed", "size"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, sizes, trees = (batch.column(k).to_pylist() for k in (2, 3, 4))
        html = ["" if not n else pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True).decode() for p, n in zip(packed, sizes, strict=True)]
        found = [Page(h).text(set(t or ())) for h, t in zip(html, trees, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])


_TREES = "key string, host long, page long, trees array<long>"


def template_hashes(keyed: DataFrame, least: int = TEMPLATE_PAGES, outside: float = OUTSIDE, inside: float = INSIDE) -> DataFrame:
    """(host, tree): the subtree hashes that recur on `least` distinct pages of a host and on a share of them. keyed: (key, host, html)."""
    rows = keyed.select(F.lit("").alias("key"), "host", "html").mapInArrow(_hashes, _TREES).select("host", "page", F.explode("trees").alias("tree"))
    counts = rows.groupBy("host", "tree").agg(F.count_distinct("page").alias("pages")).where((F.col("pages") >= least) | (F.col("tree") == _WHOLE))
    counts = materialize(counts, "trees")
    whole = counts.where(F.col("tree") == _WHOLE).select("host", F.col("pages").alias("all"))
    share = F.when(F.col("tree") % 2 == 0, outside).otherwise(inside)
    return counts.where(F.col("tree") != _WHOLE).join(whole, "host").where(F.col("pages") >= share * F.col("all")).select("host", "tree")


def extract_text(pages: DataFrame, least: int = TEMPLATE_PAGES, outside: float = OUTSIDE, inside: float = INSIDE, broadcast_trees: int = BROADCAST_TREES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    from .url_rules import host_and_path

    small_batches(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64(host).alias("host"), key.alias("key"))
    found = materialize(template_hashes(keyed.select("key", "host", "html"), least, outside, inside), "templates")
    if found.count() <= broadcast_trees:  # a size that any task can hold
        of_host: defaultdict[int, set[int]] = defaultdict(set)
        for r in found.collect():
            of_host[r["host"]].add(r["tree"])

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts, html = (batch.column(k).to_pylist() for k in (2, 3))
                texts = [Page(x).text(of_host.get(h, ())) for h, x in zip(hosts, html, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        out = keyed.select("page_id", "url", "host", "html").mapInArrow(here, "page_id long, url string, text string")
        return out.withColumn("n_chars", F.length("text").cast("long"))
    rows = keyed.select("key", "host", "html").mapInArrow(_hashes, _TREES).select("key", "host", F.explode("trees").alias("tree"))
    mine = rows.join(found, ["host", "tree"]).groupBy("key").agg(F.collect_set("tree").alias("template"))
    packed = keyed.select("page_id", "url", "key", "html").mapInArrow(_pack, "page_id long, url string, key string, packed binary, size int")
    both = packed.join(mine, "key", "left").select("page_id", "url", "packed", "size", "template")
    return both.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
