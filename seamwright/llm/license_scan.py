"""License scans: winnowed fingerprints pick candidate templates, banded alignment measures them.

Templates (license_texts, or a parameter) are cut into lower-case words; every GRAM-word gram is hashed and winnowed with
WINNOW, and the fingerprints form an inverted index. Every gram of a text is looked up in it, so that no place of a
template's fingerprint in the text can be missed; for each template hit, the hits' diagonals
give the places where it may stand. A banded alignment of words (match 2, mismatch and gap
-1, band BAND around the diagonal) then yields the matched words of the template and their span in the
text. Coverage is matched words over the template's words. Places whose words, counted, can't make up the least coverage in any order are
not aligned; stretches as long as the template are looked at first, then single places.

Null or empty texts have no match. A template occurring twice is reported at each place that does
not overlap a better one; of several templates at one place (a grant and the license that holds it) each is reported. Without templates nothing matches. Texts shorter than a gram match none; templates shorter than a gram are rejected. Repeated rows
are reported alike; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, rows_of, small_batches, text_chunks, window_hashes
from .license_texts import TEMPLATES

GRAM, WINNOW, BAND = 3, 3, 8
LEAST_COVERAGE = 0.6

def _chunk(text: str) -> Texts:
    data = np.frombuffer(text.encode(), np.uint8)
    return Texts(data, np.array([0, len(data)]), lower=True)


def winnow(hashes: np.ndarray, size: int = WINNOW) -> np.ndarray:
    """Positions of the rightmost least hash of each window of `size` hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) < size:
        return np.array([int(np.flatnonzero(hashes == hashes.min())[-1])])
    view = np.lib.stride_tricks.sliding_window_view(hashes, size)[:, ::-1]
    return np.unique(np.arange(len(view)) + size - 1 - view.argmin(axis=1))


class Index:
    """Inverted index: fingerprint -> (template, position)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words: list[list[int]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.places: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, name in enumerate(self.names):
            words = _chunk(templates[name]).word_hashes()
            if len(words) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            grams = window_hashes(words, GRAM)
            self.words.append(words.tolist())
            self.counts.append(np.unique(words, return_counts=True))
            for p in winnow(grams).tolist():
                self.places[int(grams[p])].append((t, p))
        self.prints = np.array(sorted(self.places), np.uint64)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of grams that are in the index. Every gram is looked up, so no offset of the winnowing can be missed."""
        if not len(hashes) or not len(self.prints):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.prints, hashes), len(self.prints) - 1)
        return np.flatnonzero(self.prints[k] == hashes)


def align(template: list[int], words: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first word, word after the last) of the best local alignment within the band around text = template + diagonal."""
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}
    for i, t in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)):
            options = [(0, 0, j)]
            s, m, a = before.get(j - 1, (0, 0, j))
            options.append((s + 2, m + 1, a) if words[j] == t else (s - 1, m, a))
            if j in before:
                s, m, a = before[j]
                options.append((s - 1, m, a))
            if j - 1 in now:
                s, m, a = now[j - 1]
                options.append((s - 1, m, a))
            now[j] = max(options, key=lambda o: (o[0], o[1]))
            if now[j][0] > best[0]:
                best = (now[j][0], now[j][1], now[j][2], j + 1)
        before = now
    return best[1], best[2], best[3]


class Bag:
    """How many words of a template a stretch of a text can match at most, whatever their order."""

    def __init__(self, counts: tuple[np.ndarray, np.ndarray], words: np.ndarray):
        distinct, self.counts = counts
        k = np.minimum(np.searchsorted(distinct, words), len(distinct) - 1)
        self.local = np.where(distinct[k] == words, k, len(distinct))

    def bound(self, lo: int, hi: int) -> int:
        held = np.bincount(self.local[max(0, lo) : max(0, hi)], minlength=len(self.counts) + 1)[: len(self.counts)]
        return int(np.minimum(held, self.counts).sum())


def _possible(bag: Bag, places: list[int], size: int, need: float) -> Iterator[int]:
    """The places (in bands) at which a template of `size` words may match `need` of them."""
    at = 0
    while at < len(places):
        end = at + 1
        while end < len(places) and (places[end] - places[at]) * BAND <= size:
            end += 1
        reach = lambda a, b: (a * BAND - 2 * BAND, b * BAND + size + 3 * BAND)
        if bag.bound(*reach(places[at], places[end - 1])) >= need:
            yield from (d for d in places[at:end] if bag.bound(*reach(d, d)) >= need)
        at = end


def scan(index: Index, words: np.ndarray, least: float) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, word after the last), disjoint for each template, best first."""
    grams = window_hashes(words, GRAM)
    votes: defaultdict[int, Counter[int]] = defaultdict(Counter)
    for p in index.hits(grams).tolist():
        for t, q in index.places[int(grams[p])]:
            votes[t][(p - q) // BAND] += 1
    out = []
    for t, diagonals in votes.items():
        template, found = index.words[t], []
        for d in _possible(Bag(index.counts[t], words), sorted(diagonals), len(template), least * len(template)):
            lo = max(0, d * BAND - 2 * BAND)
            part = words[lo : d * BAND + len(template) + 3 * BAND].tolist()
            matched, a, b = align(template, part, d * BAND + BAND // 2 - lo, 2 * BAND)
            if matched >= least * len(template):
                found.append((matched / len(template), -(lo + a), lo + b))
        taken: list[tuple[int, int]] = []
        for coverage, a, b in sorted(set(found), reverse=True):
            if all(b <= x or -a >= y for x, y in taken):
                taken.append((-a, b))
                out.append((index.names[t], coverage, -a, b))
    return sorted(out, key=lambda o: (o[2], -o[1], o[0]))


SCHEMA = "doc_id long, license string, coverage double, word_start long, word_end long, char_start long, char_end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each place where a template covers `least` of its words in a row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
        for batch, texts in rows_of(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for lo, _, chunk in text_chunks(texts, lower=True):
                words, first = chunk.word_hashes(), chunk.first
                hit = index.hits(window_hashes(words, GRAM))
                chars = None
                for d in np.unique(np.searchsorted(first, hit, side="right") - 1).tolist():
                    for name, coverage, a, b in scan(index, words[first[d] : first[d + 1]], least):
                        if chars is None:
                            chars = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                        base = chars[chunk.at[d]]
                        rows.append((ids[lo + d], name, coverage, a, b, int(chars[chunk.starts[first[d] + a]] - base), int(chars[chunk.ends[first[d] + b - 1]] - base)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
