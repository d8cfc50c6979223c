"""Test items leaking into a corpus (problem 9).

Rare n-gram seeds join passages to items, then Smith-Waterman alignment scores the passages.

1. One pass over the corpus finds every occurrence of any item n-gram and keeps, per document, only the
   stretches of words around them (a side table that is small unless the corpus is full of items).
2. From it each item n-gram gets its document frequency over the whole corpus. In every window of
   ``WINDOW`` words of an item the rarest n-gram is a seed. A passage that shares ``WINDOW`` consecutive words
   with an item thus always holds a seed of it, however common its n-grams are: nothing is cut off.
3. A stretch is aligned with an item if it holds one of the item's seeds: Smith-Waterman over words
   (match 2, mismatch -1, gap -1). The same sweep yields the longest run of consecutive words in common, the
   exact check.

Seeds find runs, not every edited copy: a copy with a changed word in every five shares no n-gram with its
item. ``edited`` asks for every pair with an alignment worth ``WINDOW`` matches and half of the item words it
covers, runs included, and takes another way, which needs no n-gram at all:

1. Such an alignment can be cut until it is worth 24 to 48, still half of what it covers: if it is worth more,
   one of two parts worth 24 or more is. It then covers P <= ``PART`` item words with m matches and e errors,
   e <= m, so it lies in 2 ``PART`` words of the document; and as each error ends one run of matches, its
   matches and pairs of consecutive matches are m + (m - e - 1) = score - 1 at least.
2. So a document is cut into windows that overlap by 2 ``PART`` words, and a window is aligned with an item if
   some P item words, counted once if the word is in the window and again if it is there with the next one,
   come to max(24, P) - 1 or more. No pair is missed. The work is words of documents times words of items.

The items are a query set against all documents. What tasks need of them is broadcast in blocks of ``BLOCK_WORDS``
words, which bounds it whatever their number: each block is one sweep over the documents, and as nothing in the rule
depends on other items, the result is the same for any size of blocks. An item that is longer is a block of its own.

Words are the longest runs of letters and digits of any script, lower-cased. Defined results: null texts
and texts without words match nothing; items with fewer words than ``N`` have no n-gram and match nothing;
equal items are items of their own; several rows of one item id are passages of one item; a document row that is
repeated gives its pairs once, with the best figures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stage
from siltstone.workers import with_code

N = 5
WINDOW = 12
PART = 48
BLOCK_WORDS = 500_000
WORDS = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
CHUNK_CELLS = 200_000


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)] if text else []


class _Hashes(dict):
    """64-bit hash of each word, kept for the words seen; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def gram_hashes(ws: list[str], known: dict[str, int], n: int = N) -> np.ndarray:
    """Hash of the n-gram that begins at each word."""
    if len(ws) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    out = np.zeros(len(ws) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(ws) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return out


STRETCHES = "doc_id long, start int, words array<string>, at array<int>, grams array<long>"
PAIRS = "doc_id long, item_id long, score int, run int, share double"


def reaches(items: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the items in order, and for each the words around it that an item with it may need."""
    known = _Hashes()
    grams = [gram_hashes(ws, known) for ws in items]
    every = np.concatenate([np.empty(0, np.uint64), *grams])
    lengths = np.concatenate([np.empty(0, np.int64), *(np.full(len(g), len(ws) + WINDOW) for g, ws in zip(grams, items))])
    distinct, at = np.unique(every, return_inverse=True)
    reach = np.zeros(len(distinct), np.int64)
    np.maximum.at(reach, at, lengths)
    return distinct, reach


def find_stretches(known_grams):
    """mapInArrow function: (doc_id, text) to the stretches with item n-grams; takes the broadcast of :func:`reaches`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        grams, reach = known_grams.value
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            docs = [words(t) for t in batch.column("text").to_pylist()]
            # All documents of the batch at once; n-grams that reach over an end are dropped.
            sizes = np.array([len(d) for d in docs])
            h = gram_hashes([w for d in docs for w in d], known)
            if not len(h):
                continue
            upto = np.cumsum(sizes)
            ends = np.repeat(upto, sizes)[: len(h)]
            found = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            hits = np.flatnonzero((grams[found] == h) & (np.arange(len(h)) + N <= ends))
            if not len(hits):
                continue
            owner = np.searchsorted(upto, hits, side="right")
            begins = (upto - sizes)[owner]
            pad = reach[found[hits]]
            lo, hi = np.maximum(begins, hits - pad), np.minimum(upto[owner], hits + N + pad)
            # Spans of one document that overlap are one stretch; spans of two documents never do.
            order = np.argsort(lo, kind="stable")
            far = np.maximum.accumulate(hi[order])
            cut = np.flatnonzero(np.concatenate([[True], lo[order][1:] >= far[:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(hits))):
                own = np.sort(hits[order[a:b]])
                d = int(owner[order[a]])
                first, start = int(begins[order[a]]), int(lo[order[a]])
                out.append((ids[d], start - first, docs[d][start - first : int(far[b - 1]) - first], (own - start).tolist(), h[own].view(np.int64).tolist()))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "words", "at", "grams"])

    return run


def align(stretch: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score and the longest run in common, of two sequences of word numbers."""
    scores, runs = align_many([stretch], [item])
    return int(scores[0]), int(runs[0])


def align_many(stretches: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and longest runs of many pairs: one sweep over item words moves all pairs of a chunk at once.

    Pairs of similar length share a chunk; shorter ones are filled up with words that match nothing.
    """
    scores, longest = np.zeros(len(stretches), np.int32), np.zeros(len(stretches), np.int32)
    order = np.argsort([len(s) for s in stretches], kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * (len(stretches[order[to]]) + 1) <= CHUNK_CELLS:
            to += 1
        chunk = order[at:to]
        at = to
        wide, high = max(len(stretches[i]) for i in chunk), max(len(items[i]) for i in chunk)
        text, query = np.full((len(chunk), wide), -1, np.int32), np.full((len(chunk), high), -2, np.int32)
        for k, i in enumerate(chunk):
            text[k, : len(stretches[i])] = stretches[i]
            query[k, : len(items[i])] = items[i]
        steps = np.arange(wide + 1, dtype=np.int32)
        row, run = np.zeros((len(chunk), wide + 1), np.int32), np.zeros((len(chunk), wide + 1), np.int32)
        best, most = np.zeros(len(chunk), np.int32), np.zeros(len(chunk), np.int32)
        for j in range(high):
            same = text == query[:, j : j + 1]
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            # Gaps along the stretch: the best earlier cell less one per step.
            row = np.maximum.accumulate(new - GAP * steps, axis=1) + GAP * steps
            following = np.zeros_like(run)
            following[:, 1:] = (run[:, :-1] + 1) * same
            run = following
            np.maximum(best, row.max(axis=1), out=best)
            np.maximum(most, run.max(axis=1), out=most)
        scores[chunk], longest[chunk] = best, most
    return scores, longest


def seeds(items: dict[int, list[str]], frequency: dict[int, int]) -> dict[int, set[int]]:
    """item: its seeds, the rarest n-gram of each window of its words (of the whole item if it is shorter)."""
    known = _Hashes()
    out: dict[int, set[int]] = {}
    for item, ws in items.items():
        grams = gram_hashes(ws, known).view(np.int64).tolist()
        width = WINDOW - N + 1
        windows = [grams[i : i + width] for i in range(max(1, len(grams) - width + 1))] if grams else []
        # A window with an n-gram that occurs nowhere is nowhere whole; its others still lead to edited copies.
        present = [[g for g in w if g in frequency] for w in windows]
        out[item] = {min(w, key=lambda g: (frequency[g], g)) for w in present if w}
    return out


def _scored(pairs: list[tuple[int, int]], stretches: list[np.ndarray], coded: dict[int, np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
    """Rows of pairs (document, number of an item)."""
    scores, runs = align_many(stretches, [coded[i] for _, i in pairs])
    numbers = np.array([i for _, i in pairs])
    share = scores / (MATCH * np.array([len(coded[i]) for i in numbers]))
    columns = [pa.array([d for d, _ in pairs], pa.int64()), pa.array(ids[numbers], pa.int64()), pa.array(scores), pa.array(runs), pa.array(share, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "run", "share"])


def aligned(block):
    """mapInArrow function: stretches to (doc_id, item_id, score, run, share) of every item they hold a seed of.

    ``block`` is the broadcast of item ids, item words and {seed: numbers of items}.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, by_seed = block.value
        numbers: dict[str, int] = {}
        for ws in items:
            for w in ws:
                numbers.setdefault(w, len(numbers))
        coded = {i: np.array([numbers[w] for w in ws], np.int32) for i, ws in enumerate(items)}
        for batch in batches:
            found: list[tuple[int, int]] = []
            stretches: list[np.ndarray] = []
            for doc, ws, grams in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "words", "grams"))):
                candidates = {i for g in set(grams) for i in by_seed.get(g, ())}
                if candidates:
                    stretch = np.array([numbers.get(w, -1) for w in ws], np.int32)
                    found += [(doc, i) for i in candidates]
                    stretches += [stretch] * len(candidates)
            if found:
                yield _scored(found, stretches, coded, ids)

    return run


class Near:
    """Items with which a window of a document may have an alignment worth 24 and half of the item words it covers."""

    def __init__(self, items: dict[int, list[str]]):
        self.numbers: dict[str, int] = {}
        for ws in items.values():
            for w in ws:
                self.numbers.setdefault(w, len(self.numbers))
        self.coded = {i: np.array([self.numbers[w] for w in ws], np.int64) for i, ws in items.items()}
        # All items in a row, an end mark after each; a place is its word, or its word and the next.
        self.ids = [i for i, c in self.coded.items() if len(c) >= WINDOW]
        mark = len(self.numbers)
        self.flat = np.concatenate([np.empty(0, np.int64), *(np.append(self.coded[i], mark) for i in self.ids)])
        self.owner = np.repeat(np.arange(len(self.ids)), [len(self.coded[i]) + 1 for i in self.ids])
        self.ends = np.flatnonzero(self.flat == mark)
        self.pairs, self.pair_at = np.unique(self._pairs(self.flat), return_inverse=True)
        self.word_in, self.pair_in = np.zeros(mark + 1, bool), np.zeros(len(self.pairs) + 1, bool)

    def _pairs(self, codes: np.ndarray) -> np.ndarray:
        return codes[:-1] * (len(self.numbers) + 1) + codes[1:]

    def code(self, ws: list[str]) -> np.ndarray:
        return np.fromiter((self.numbers.get(w, -1) for w in ws), np.int64, len(ws))

    def of(self, window: np.ndarray) -> list[int]:
        """The items, by number."""
        known = window[window >= 0]
        if not self.ids or not len(known):
            return []
        pairs = self._pairs(window)[(window[:-1] >= 0) & (window[1:] >= 0)]
        found = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        found = found[self.pairs[found] == pairs]
        self.word_in[known], self.pair_in[found] = True, True
        worth = self.word_in[self.flat].astype(np.int32)
        # A pair counts at its second word, so some item words in a row count all pairs between them.
        worth[1:] += self.pair_in[self.pair_at]
        self.word_in[known], self.pair_in[found] = False, False
        least = MATCH * WINDOW - 1
        # Most items don't come to the least anywhere; ends are left out of account here, which only adds some.
        total = np.cumsum(np.concatenate([[0], worth, np.zeros(PART, np.int32)]))
        begins = np.flatnonzero(total[PART:] - total[:-PART] >= least)
        if not len(begins):
            return []
        likely = np.zeros(len(self.ids), bool)
        likely[self.owner[np.minimum(begins, len(worth) - 1)]] = True
        places = np.flatnonzero(likely[self.owner])
        worth[self.ends] = -4 * PART
        owner, total = self.owner[places], np.concatenate([[0], np.cumsum(worth[places])])
        out: set[int] = set()
        for p in range(WINDOW, min(PART, len(places)) + 1):
            at = np.flatnonzero(total[p:] - total[:-p] >= max(least, p - 1))
            out.update(owner[at].tolist())
        return [self.ids[k] for k in sorted(out)]


def near_pairs(block):
    """mapInArrow function: (doc_id, text) to (doc_id, item_id, score, run, share) of every pair that may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, _ = block.value
        near = Near(dict(enumerate(items)))
        for batch in batches:
            found: list[tuple[int, int]] = []
            stretches: list[np.ndarray] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                codes = near.code(words(text))
                reach: dict[int, list[list[int]]] = {}
                for a in range(0, max(1, len(codes) - 2 * PART), 2 * PART):
                    for i in near.of(codes[a : a + 4 * PART]):
                        # A better alignment of the pair reaches no further than twice the item.
                        lo, hi = max(0, a - 2 * len(near.coded[i])), a + 4 * PART + 2 * len(near.coded[i])
                        spans = reach.setdefault(i, [])
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = hi
                        else:
                            spans.append([lo, hi])
                for i, spans in reach.items():
                    found += [(doc, i)] * len(spans)
                    stretches += [codes[lo:hi] for lo, hi in spans]
            if found:
                yield _scored(found, stretches, near.coded, ids)

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
    """Ids and words of the items, so many at a time that a block has ``BLOCK_WORDS`` words at most, or one item."""
    ids: list[int] = []
    block: list[list[str]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct().toLocalIterator():
        ws = words(r["text"])
        if not ws:
            continue
        if block and size + len(ws) > BLOCK_WORDS:
            yield np.array(ids, np.int64), block
            ids, block, size = [], [], 0
        ids.append(r["item_id"])
        block.append(ws)
        size += len(ws)
    if block:
        yield np.array(ids, np.int64), block


def find_leaks(docs: DataFrame, items: DataFrame, edited: bool = False) -> DataFrame:
    """doc_id, item_id, score, run, share: the best alignment of every document with every item it holds a seed of.

    ``docs`` and ``items`` have doc_id or item_id, and text. ``score`` is the Smith-Waterman score, ``run``
    the longest run of consecutive words in common, ``share`` the score against that of the whole item.
    ``edited``: of every pair with an alignment worth ``WINDOW`` matches and half of the item words it covers.
    """
    spark = docs.sparkSession
    texts = with_code(docs).select(F.col("doc_id").cast("long"), "text").where("text is not null")
    found: DataFrame | None = None
    for ids, block in _blocks(items):
        pairs = _edited_pairs(texts, ids, block) if edited else _seeded_pairs(texts, ids, block)
        if pairs is not None:
            pairs = stage(pairs, "leaks")
            found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return spark.createDataFrame([], PAIRS)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.max("share").alias("share"))


def _edited_pairs(texts: DataFrame, ids: np.ndarray, block: list[list[str]]) -> DataFrame:
    return texts.mapInArrow(near_pairs(texts.sparkSession.sparkContext.broadcast((ids, block, None))), PAIRS)


def _seeded_pairs(texts: DataFrame, ids: np.ndarray, block: list[list[str]]) -> DataFrame | None:
    sc = texts.sparkSession.sparkContext
    grams = reaches(block)
    if not len(grams[0]):
        return None
    stretches = stage(texts.mapInArrow(find_stretches(sc.broadcast(grams)), STRETCHES), "stretches")
    counts = stretches.select("doc_id", F.explode(F.array_distinct("grams")).alias("g")).distinct().groupBy("g").count()
    frequency = {r["g"]: r["count"] for r in counts.toLocalIterator()}  # at most one row per n-gram of the block
    by_seed: dict[int, list[int]] = {}
    for item, gs in seeds(dict(enumerate(block)), frequency).items():
        for g in gs:
            by_seed.setdefault(g, []).append(item)
    return stretches.repartition(F.xxhash64("doc_id", "start")).mapInArrow(aligned(sc.broadcast((ids, block, by_seed))), PAIRS)
