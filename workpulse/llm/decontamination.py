"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, A-Z lowered. Runs of `SEED` words that a document shares with a benchmark item are seeds, found by
a running Karp-Rabin value over the document's words. Seeds that follow each other on one diagonal are a match. Tiling then marks the
longest match, cuts what it covers out of the other matches, and goes on while a match of `SEED` words is left; no word of
either text is marked twice. An item leaks into a document if the tiles cover at least ``COVERAGE`` of the item's words, in
whatever order the document has them.

The documents are not shuffled: every task holds the seeds of a part of the benchmark of at most about ``PER_PASS`` words. A larger
benchmark takes several passes over the documents, one after the other, each stored before the next part is read: driver and tasks hold one part
at a time, whatever the benchmark's size.

Null and empty texts, and items of fewer than ``SEED`` words, match nothing. Ties between matches go to the earlier place in the document,
then in the item. Repeated documents and items are reported each. An empty table gives no rows. Further columns pass unchanged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workpulse.llm.storage import stored
from workpulse.llm.text import PUNCTUATION, parts, shingles, tidy, word_values, words

SEED = 5
COVERAGE = 0.75
PER_PASS = 2_000_000
HELD = 2_000_000  # seeds of a slice of documents that are held at once
_SIEVE = 22  # bits of the table that most of a document's runs fail


def _values(data, offsets):
    starts, ends, firsts = words(data, offsets, PUNCTUATION)
    return word_values(data, starts, ends), firsts


def tile(matches: list[tuple[int, int, int]], size: int, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles out of maximal matches ``(length, place in the text, place in the item of size words)``; each is as long as any match then left."""
    heap = [(-length, t, p) for length, t, p in matches if length >= least]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), set(), []
    while heap and size - len(in_item) >= least:
        length, t, p = heapq.heappop(heap)
        free = [t + k not in in_text and p + k not in in_item for k in range(-length)]
        if all(free):
            tiles.append((-length, t, p))
            in_text.update(range(t, t - length))
            in_item.update(range(p, p - length))
            continue
        start = 0
        for k, open_ in enumerate([*free, False]):
            if not open_:
                if k - start >= least:
                    heapq.heappush(heap, (start - k, t + start, p + start))
                start = k + 1
    return tiles


class Seeds:
    """Runs of ``SEED`` words of some items, by value."""

    def __init__(self, item_ids: list, texts: pa.Array):
        self.item_ids, values, owners, places, self.lengths, all_words = item_ids, [], [], [], [], []
        for i, j, data, offsets in parts(texts):
            of_words, firsts = _values(data, offsets)
            runs, first = shingles(of_words, firsts, SEED, whole=False)
            counts = np.diff(first)
            values.append(runs)
            owners.append(np.repeat(np.arange(i, j), counts))
            places.append(np.arange(len(runs)) - np.repeat(first[:-1], counts))
            self.lengths += np.diff(firsts).tolist()
            all_words.append(of_words)
        self.words = np.concatenate([np.zeros(0, np.uint64), *all_words])
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        values = np.concatenate([np.zeros(0, np.uint64), *values])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owners = np.concatenate([np.zeros(0, np.int64), *owners])[order]
        self.places = np.concatenate([np.zeros(0, np.int64), *places])[order]
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(self.values >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True

    def leaks(self, data: np.ndarray, offsets: np.ndarray):
        """``text, item, words of it covered, tiles`` of each text and item that leaks into it."""
        of_words, firsts = _values(data, offsets)
        runs, first = shingles(of_words, firsts, SEED, whole=False)
        near = np.flatnonzero(self.sieve[(runs >> np.uint64(64 - _SIEVE)).astype(np.int64)])
        low, high = np.searchsorted(self.values, runs[near]), np.searchsorted(self.values, runs[near], "right")
        times = high - low
        if not times.sum():
            return
        # Words that repeat give many seeds, so seeds are made in runs and only the ends of matches are kept.
        begins, ends = [], []
        inner = np.searchsorted(np.cumsum(times), np.arange(HELD, int(times.sum()), HELD))
        bounds = np.unique(np.concatenate([[0], inner, [len(times)]])).tolist()
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            n = times[x:y]
            seed = np.repeat(low[x:y] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(near[x:y], n)
            text = np.searchsorted(first, at, "right") - 1
            item, p, t = self.owners[seed], self.places[seed], at - first[text]
            where, other = firsts[text] + t, self.firsts[item] + p
            opens = (t == 0) | (p == 0)
            opens[~opens] = of_words[where[~opens] - 1] != self.words[other[~opens] - 1]
            closes = (where + SEED >= firsts[text + 1]) | (other + SEED >= self.firsts[item + 1])
            closes[~closes] = of_words[where[~closes] + SEED] != self.words[other[~closes] + SEED]
            rows = np.stack([text, item, t - p, t])
            begins.append(rows[:, opens])
            ends.append(rows[:, closes])
        # Along a diagonal every match opens once and then closes once.
        begins, ends = (np.concatenate(x, 1) for x in (begins, ends))
        begins, ends = (x[:, np.lexsort(x[::-1])] for x in (begins, ends))
        text, item, _, t = begins
        p, lengths = t - begins[2], ends[3] - t + SEED
        begins = np.arange(len(t))
        pair = np.ones(len(begins), bool)
        pair[1:] = (np.diff(text[begins]) != 0) | (np.diff(item[begins]) != 0)
        bounds = np.append(np.flatnonzero(pair), len(begins))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = begins[a:b]
            size = self.lengths[item[own[0]]]
            if lengths[a:b].sum() < COVERAGE * size:  # tiles cover at most all matches
                continue
            tiles = tile(list(zip(lengths[a:b].tolist(), t[own].tolist(), p[own].tolist(), strict=True)), size)
            covered = sum(x[0] for x in tiles)
            if covered >= COVERAGE * size:
                yield int(text[own[0]]), int(item[own[0]]), covered, len(tiles)


def passes(benchmark: DataFrame):
    """``seeds, last`` of the benchmark's parts, of at most about ``PER_PASS`` words each, and whether it is the last part."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    count = int(total // PER_PASS) + 1
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).toArrow()
        yield Seeds(part["item_id"].to_pylist(), part["text"].combine_chunks()), k == count - 1


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, coverage, tiles``: a row for each document and item that leaks into it."""
    kind, item_kind = (frame.schema[name].dataType.simpleString() for frame, name in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, item_words bigint, covered_words bigint, coverage double, tiles bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for seeds, last in passes(benchmark):

        def rows(batches, seeds=seeds):
            for batch in batches:
                for i, _, data, offsets in parts(batch.column(1)):
                    found = list(seeds.leaks(data, offsets))
                    if found:
                        text, item, covered, tiles = zip(*found, strict=True)
                        size = np.array([seeds.lengths[x] for x in item], np.int64)
                        ids = batch.column(0).take(pa.array([i + x for x in text]))
                        yield pa.RecordBatch.from_pydict({"doc_id": ids, "item_id": [seeds.item_ids[x] for x in item], "item_words": size, "covered_words": np.array(covered, np.int64), "coverage": np.array(covered) / size, "tiles": np.array(tiles, np.int64)})

        found = docs.select("doc_id", "text").mapInArrow(tidy(rows), schema)
        out = out.unionByName(found if last else stored(found, "leaks"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, columns as they are."""
    text = docs.columns.index("text")
    for seeds, last in passes(benchmark):

        def rows(batches, seeds=seeds):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, offsets in parts(batch.column(text)):
                    clean[[i + found[0] for found in seeds.leaks(data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(rows), docs.schema)
        docs = docs if last else stored(docs, "clean")
    return docs
