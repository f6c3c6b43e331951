"""Benchmark decontamination: a BM25 index of the test items, and every training passage as a query to it.

Words are runs of word characters, lower case, and single letters in scripts without spaces between words (``shared.UNSPACED``).

Index.  Each item is a document of the index; a term's impact on an item is its BM25 contribution divided by the item's
score against itself, so that one threshold fits all items.  The terms of an item that are most common in the benchmark
and together weigh at most ``SLACK`` are not posted; they count when an item is scored.  A term's postings, by item, lie in blocks of
``BLOCK`` with the largest impact and the last item of each.

Passages.  Items are indexed by class of length: up to ``MIN_SEGMENT`` words, up to twice as many, and so on.  For a class,
a document's words are dealt to segments of the class's length; a passage is two adjacent segments, so that an item's
text lies whole in some passage, and a passage is not longer for the sake of longer items.

Query.  Block-max WAND, for many passages in step: a passage has a cursor for each of its terms.  In the order of the
cursors' items, the largest impacts of the terms add up to the threshold at the pivot; no item before it can reach the threshold.
If the impacts of the blocks that the pivot falls into can't either, all cursors up to it skip to the end of the nearest of these
blocks or to the next cursor's item; else they move to the pivot, and an item that they all meet is scored.  All items at or
above the threshold ``MIN_SCORE`` are kept, not the best few.

Verification.  An item is split into question and answer (its last sentence, or its last quarter when there is only
one; or columns of their own).  It is a hit when at least ``MIN_OVERLAP`` of the question's word triples *and* of the
answer's occur in the passage (shorter parts: the whole part).

Scale.  One narrow pass over whole texts, no shuffle.  Only the benchmark is broadcast, and its size is checked: above
``INDEX_BYTES`` its rows are numbered, written and dealt to parts, as many as make each part's bytes fit (an item that is larger alone is a part of its own), and each
is searched by a pass of its own over the texts, with term statistics of the whole benchmark; an item's passages depend on the item alone, so hits are the same.  Cursors of passages
in step take ``CELLS`` cells.

Cases.  Null text or one without words: no hits.  Items without words or null text: never hit.  Items without an id:
hits with a null item_id.  Equal items: each is reported.  Repeated documents: each gets its row.  Extra columns of either table are
ignored, or kept where ``keep`` names them; a column ``hits`` of the input is replaced.  Empty benchmark: no hits.  Empty documents: no rows.  Very long texts are
scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, map_texts
from strandloom.llm.shared import split_words as words

K1, B = 1.2, 0.75
MIN_SCORE, SLACK, MIN_OVERLAP = 0.5, 0.2, 0.5
BLOCK = 16
NGRAM = 3
INDEX_BYTES = 16 << 20
CELLS = 1 << 18
BATCH_WORDS = 1 << 17
MIN_SEGMENT = 32
_SENTENCE = re.compile(r"[.!?\n。！？]+\s*")
HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer words of an item that has one text."""
    parts = [w for s in _SENTENCE.split(text or "") if (w := words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    end = len(only) - max(1, len(only) // 4)
    return only[:end], only[end:]


def class_of(n: int) -> int:
    """The words of a segment for items of ``n`` words."""
    size = MIN_SEGMENT
    while size < n:
        size *= 2
    return size


class _Postings:
    """The inverted index of the items of one class; ``weights``: for each item its terms' impacts, those posted first, and how many are posted."""

    def __init__(self, size: int, items: list[int], weights: list[tuple[list[tuple[int, float]], int]], n_terms: int, least: float):
        self.size, self.items, self.least, self.n = size, items, least, len(items)
        posted = sorted((t, i, x) for i, (terms, n) in enumerate(weights) for t, x in terms[:n])
        term = np.array([t for t, _, _ in posted], np.int64)
        first = np.searchsorted(term, np.arange(n_terms + 1))
        # every list ends with a posting of an item that does not exist
        at = np.arange(len(term)) + term
        total = len(term) + n_terms
        self.first = first + np.arange(n_terms + 1)
        self.item, self.impact = np.full(total, self.n, np.int64), np.zeros(total)
        self.item[at], self.impact[at] = [i for _, i, _ in posted], [x for _, _, x in posted]
        owner = np.repeat(np.arange(n_terms), np.diff(self.first))
        self.key = owner * (self.n + 1) + self.item
        place = np.arange(total) - self.first[owner]
        begins = np.flatnonzero(place % BLOCK == 0)
        self.block = np.cumsum(place % BLOCK == 0) - 1
        self.block_max = np.maximum.reduceat(self.impact, begins) if total else np.empty(0)
        self.block_last = self.item[np.append(begins[1:], total) - 1] if total else np.empty(0, np.int64)
        self.largest = np.maximum.reduceat(self.impact, self.first[:-1]) if n_terms else np.empty(0)

    def candidates(self, ids: np.ndarray, passage: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(passage, item) pairs that the posted terms leave possible; ``ids``: terms of passages 0 .. n - 1, -1 for others."""
        known = ids >= 0
        ids, passage = ids[known], passage[known]
        posted = self.largest[ids] > 0
        pairs = np.unique(passage[posted] * len(self.largest) + ids[posted])
        owner, term = pairs // max(1, len(self.largest)), pairs % max(1, len(self.largest))
        reach = np.bincount(owner, self.largest[term], n) >= self.least
        owner, term = owner[reach[owner]], term[reach[owner]]
        some, count = np.unique(owner, return_counts=True)
        starts = np.cumsum(count) - count
        order = np.argsort(count, kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * count[order[stop]] <= CELLS:
                stop += 1
            part = order[at:stop]
            width = int(count[part].max())
            column = np.arange(width)
            held = column < count[part][:, None]
            terms = np.where(held, term[np.minimum(starts[part][:, None] + column, len(term) - 1)], -1)
            yield from self._wand(some[part], terms)
            at = stop

    def _wand(self, passage: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        real = terms >= 0
        terms = np.where(real, terms, 0)
        place = np.where(real, self.first[terms], 0)
        item = np.where(real, self.item[place], self.n)
        bound = np.where(real, self.largest[terms], 0.0)
        base = terms * (self.n + 1)
        while len(passage):
            order = np.argsort(item, axis=1)
            ordered = np.take_along_axis(item, order, axis=1)
            enough = (np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1) >= self.least) & (ordered < self.n)
            alive = enough.any(axis=1)
            if not alive.all():
                passage, place, item, bound, base, ordered, enough = (x[alive] for x in (passage, place, item, bound, base, ordered, enough))
                if not len(passage):
                    return
            pivot = np.take_along_axis(ordered, enough.argmax(axis=1)[:, None], axis=1)
            upto = item <= pivot
            row, column = np.nonzero(upto)
            ahead = np.searchsorted(self.key, base[row, column] + pivot[row, 0])
            block = self.block[ahead]
            possible = np.bincount(row, self.block_max[block], len(passage)) >= self.least
            meet = possible & (ordered[:, 0] == pivot[:, 0])
            if meet.any():
                here = item == pivot
                score = np.where(here, self.impact[place], 0.0).sum(axis=1)
                found = np.flatnonzero(meet & (score >= self.least))
                yield from zip(passage[found].tolist(), pivot[found, 0].tolist())
            beyond = np.where(upto, self.n, item).min(axis=1)
            last = np.full(len(passage), self.n)
            np.minimum.at(last, row, self.block_last[block])
            target = np.where(possible, pivot[:, 0] + meet, np.minimum(last + 1, beyond))
            moves = item[row, column] < target[row]
            row, column = row[moves], column[moves]
            ahead = np.searchsorted(self.key, base[row, column] + target[row])
            place[row, column], item[row, column] = ahead, self.item[ahead]


class Index:
    """The index of some items; ``df``, ``n_items`` and ``mean_words`` are of the whole benchmark."""

    def __init__(self, items: Sequence[tuple[int | None, list[str], list[str]]], df: dict[str, int], n_items: int, mean_words: float):
        items = sorted(((i, q, a) for i, q, a in items if q or a), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        self.ids = [i for i, _, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.impacts: list[list[tuple[int, float]]] = []
        classes: dict[int, list[int]] = {}
        weights: list[tuple[list[tuple[int, float]], int]] = []
        slack = 0.0
        for k, (_, q, a) in enumerate(items):
            bag = Counter(q + a)
            n = sum(bag.values())
            classes.setdefault(class_of(n), []).append(k)
            raw = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean_words)) for t, f in bag.items()}
            own = math.fsum(raw.values())
            terms = [(self.vocabulary.setdefault(t, len(self.vocabulary)), raw[t] / own) for t in sorted(raw, key=lambda t: (df[t], t))]
            spare, posted = 0.0, len(terms)
            while posted and spare + terms[posted - 1][1] <= SLACK:
                posted -= 1
                spare += terms[posted][1]
            slack = max(slack, spare)
            self.impacts.append(terms)
            weights.append((terms, posted))
        code = self.vocabulary
        self.parts = [[self._grams([code[w] for w in part]) for part in (q, a)] for _, q, a in items]
        self.classes = [_Postings(size, mine, [weights[k] for k in mine], len(code), MIN_SCORE - slack - 1e-9) for size, mine in sorted(classes.items())]

    @staticmethod
    def _grams(ids: list[int]) -> tuple[int, set[tuple[int, ...]]]:
        n = min(NGRAM, len(ids))
        return n, {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if n else set()

    def _verified(self, ids: list[int], i: int) -> tuple[float, float, float] | None:
        """Score and overlaps of an item against a passage, if it is a hit."""
        have = set(ids)
        score = math.fsum(x for t, x in self.impacts[i] if t in have)
        if score < MIN_SCORE:
            return None
        overlaps = []
        for n, wanted in self.parts[i]:
            grams = {tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)} if n else set()
            overlaps.append(len(wanted & grams) / len(wanted) if n else 1.0)
        return (score, *overlaps) if min(overlaps) >= MIN_OVERLAP else None

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the items that are hit, by position, with score and overlaps."""
        out: list[dict] = [{} for _ in texts]
        if not self.ids:
            return out
        get = self.vocabulary.get
        at = 0
        while at < len(texts):
            ids: list[int] = []
            ends = []
            first = at
            while at < len(texts) and (at == first or len(ids) < BATCH_WORDS):
                ids += [get(w, -1) for w in words(texts[at])]
                ends.append(len(ids))
                at += 1
            for postings in self.classes:
                self._search(postings, np.array(ids, np.int64), np.array(ends), out[first:at])
        return out

    def _search(self, postings: _Postings, ids: np.ndarray, ends: np.ndarray, out: list[dict]) -> None:
        size = postings.size
        begins = np.append(0, ends[:-1])
        count = -(-(ends - begins) // size)
        owner = np.repeat(np.arange(len(ends)), count)
        start = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * size
        stop = np.minimum(start + 2 * size, ends[owner])  # a passage: this segment and the next of its text
        for lo in range(0, len(owner), max(1, BATCH_WORDS // size)):
            a, b = start[lo : lo + max(1, BATCH_WORDS // size)], stop[lo : lo + max(1, BATCH_WORDS // size)]
            span = b - a
            at = np.arange(span.sum()) + np.repeat(a - np.cumsum(span) + span, span)
            for k, i in postings.candidates(ids[at], np.repeat(np.arange(len(a)), span), len(a)):
                i = postings.items[i]
                if hit := self._verified(ids[a[k] : b[k]].tolist(), i):
                    found = out[owner[lo + k]]
                    found[i] = max(found.get(i, (0.0, 0.0, 0.0)), hit)


def _items(benchmark: DataFrame, item_id: str, text: str, question: str | None, answer: str | None) -> DataFrame:
    parts = [F.col(question).alias("q"), F.col(answer).alias("a")] if question and answer else [F.col(text).alias("q"), F.lit(None).cast("string").alias("a")]
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), *parts)


def _split(row) -> tuple[int, list[str], list[str]]:
    return (row.item_id, *(split_item(row.q) if row.a is None else (words(row.q), words(row.a))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", question: str | None = None, answer: str | None = None) -> DataFrame:
    """The columns ``keep`` of every document, with ``hits`` (``HITS``, by item_id); a document is contaminated iff it has any."""
    items = _items(benchmark, item_id, item_text, question, answer)
    size = items.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0))).alias("b")).first().b or 0
    n_parts = -(-size // INDEX_BYTES) or 1
    if n_parts > 1:
        return _by_parts(docs, items, int(n_parts), keep, text)
    rows = [_split(r) for r in items.collect()]  # at most INDEX_BYTES of text
    return _search(docs, rows, *_statistics(rows), keep, text)


def _statistics(rows) -> tuple[dict[str, int], int, float]:
    full = [q + a for _, q, a in rows if q or a]
    return dict(Counter(t for w in full for t in set(w))), len(full), sum(map(len, full)) / max(1, len(full))


def _search(docs: DataFrame, rows, df: dict[str, int], n_items: int, mean_words: float, keep: tuple[str, ...], text: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Index(rows, df, n_items, mean_words))

    def find(texts: list[str | None]) -> list:
        index = held.value
        return [[[{"item_id": index.ids[i], "score": s, "question_overlap": q, "answer_overlap": a} for i, (s, q, a) in sorted(x.items())] for x in index.search(texts)]]

    return map_texts(docs, text, keep, find, f"hits {HITS}")


def _by_parts(docs: DataFrame, items: DataFrame, n_parts: int, keep: tuple[str, ...], text: str) -> DataFrame:
    """A benchmark above INDEX_BYTES: hits of one part after another, each a pass that carries the earlier parts' hits."""
    items = cut(items.withColumn("number", F.monotonically_increasing_id()), "benchmark")  # equal items have numbers of their own
    both = items.withColumn("t", F.concat_ws("\n", "q", "a"))
    terms = cut(map_texts(both, "t", (), lambda ts: [[sorted(set(words(t))) for t in ts], [len(words(t)) for t in ts]], "terms array<string>, n int").where("n > 0"), "benchmark-terms")
    n_items, mean_words = terms.agg(F.count(F.lit(1)), F.avg("n")).first()
    counts = cut(terms.select(F.explode("terms").alias("t")).groupBy("t").count(), "benchmark-counts")
    dealt = _dealt(items, n_parts)
    out, names = docs, []
    for part in [r["part"] for r in dealt.select("part").distinct().orderBy("part").collect()]:
        rows = [_split(r) for r in dealt.where(F.col("part") == part).collect()]  # at most INDEX_BYTES of text, or one item
        mine = docs.sparkSession.createDataFrame([(t,) for t in sorted({t for _, q, a in rows for t in q + a})] or [("",)], "t string")
        df = {r.t: r["count"] for r in counts.join(mine, "t").collect()}
        names.append(f"__hits{part}")
        out = _search(out, rows, df, n_items, mean_words, (*keep, *names[:-1], text), text).withColumnRenamed("hits", names[-1])
    hits = reduce(lambda a, b: F.concat(a, b), map(F.col, names))
    return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keep)], F.array_sort(hits).alias("hits"))


def _dealt(items: DataFrame, n_parts: int) -> DataFrame:
    """``items`` with ``part``: at first ``n_parts`` parts; one above INDEX_BYTES is dealt again, until it fits or is one item."""
    size = F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0))
    while True:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(n_parts)))
        parts = dealt.groupBy("part").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
        if not parts.where((F.col("bytes") > INDEX_BYTES) & (F.col("n") > 1)).take(1):
            return dealt
        n_parts *= 2
