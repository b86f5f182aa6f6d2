"""Removal of long repeated passages by prefix-free parsing.

Every string of ``LENGTH`` bytes that starts at two places marks its bytes at both; marked bytes go. Matches stay within documents.

*Parse.* A rolling value over ``WINDOW`` bytes fires about every ``EVERY`` bytes and ends a phrase there. What fires depends on those bytes
alone, so equal strings are parsed alike. A string belongs to the first trigger that lies wholly in it, if one does within ``REACH`` bytes, else
to the first trigger of a finer rolling value, else to itself. All strings of a trigger share its *core*, the bytes around it, and together they cover its
*context*. A trigger with its range of starts stands for all of its strings, so the parse is far shorter than the text.

*Order.* Where suffix arrays of dictionary and parse sort suffixes to bring equal beginnings together, here triggers are sorted by core, context and place,
over the whole corpus and by ranges, so that no core is one task's. Order among different contents is of no use for finding repeats, so
64-bit values of core and context take the place of the texts. A core without an equal neighbour ends there: nothing of it repeats.

*Dictionary.* Equal contexts are one entry. An entry that occurs twice repeats as a whole. Only where one core has several entries, and one of them occurs
once, the entry's starts are divided into blocks, each with a core and a context of its own, and these are sorted and compared in the same way; first
blocks of `BLOCKS` starts, then, where it is still open, single ones. The dictionary keeps the bytes of such entries, each once. So exact copies, however many, cost
one entry, and only the edges of matches are worked out byte by byte.

Strings count as equal if the values of core and context agree, two polynomials modulo 2**61 - 1 with bases of their own.

Nulls, ties and odd input: a null text is empty; rows that repeat a document are two places, so their long texts go in both; null ids are allowed, rows
are told apart by id and a 64-bit hash of the text; texts shorter than ``LENGTH`` stay whole. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workpulse.llm.storage import discard, scratch, stored
from workpulse.llm.text import U64, mixed, parts, powers

LENGTH = 400
WINDOW = 16
EVERY = 100
FINER = 16
REACH = 368  # a trigger ends at most so far after the start of its strings; the rest of a string is part of the core
BLOCKS = (16, 1)
STARTS = 1 << 17  # bytes worked on at once; of a longer text, so many starts of strings
ENTRIES = 4096  # of one document that the dictionary gives at once
_AFTER = LENGTH - REACH
_BASE = 0xA0761D6478BD642F | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_NO_ID = -(1 << 63)
_KEY = "core bigint, context bigint, id bigint, mark bigint, place bigint"
_BLOCK = f"{_KEY}, entry bigint, single boolean"


_P = (1 << 61) - 1  # a prime: modulo a power of two, polynomials of regular strings can be equal whatever the base
_LOW29, _LOW32 = U64((1 << 29) - 1), U64((1 << 32) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & U64(_P)) + (x >> U64(61))
    return np.where(x >= U64(_P), x - U64(_P), x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """A number as large as ``x * 2**32`` modulo the prime, below 2**62; ``x`` is below 2**62."""
    return (x >> U64(29)) + ((x & _LOW29) << U64(32))


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x * y`` modulo the prime, of numbers below it."""
    low_x, high_x, low_y, high_y = x & _LOW32, x >> U64(32), y & _LOW32, y >> U64(32)
    crossed = low_x * high_y + high_x * low_y
    return _reduced(_reduced(low_x * low_y) + _shifted(crossed) + ((high_x * high_y) << U64(3)))


class _Lane:
    """One polynomial over bytes modulo the prime: codes of the bytes, and powers of its base and of the inverse, grown by doubling."""

    def __init__(self, seed: int):
        random = np.random.Generator(np.random.PCG64(seed))
        self.codes = random.integers(1, 1 << 29, 256, dtype=np.uint64)
        base = int(random.integers(1 << 59, 1 << 60))
        self.bases = {"up": base, "down": pow(base, -1, _P)}
        self.held = {name: np.ones(1, U64) for name in self.bases}

    def powers(self, name: str, count: int) -> np.ndarray:
        have = self.held[name]
        while len(have) < count:
            have = np.concatenate([have, product(have, U64(pow(self.bases[name], len(have), _P)))])
        self.held[name] = have
        return have[:count]


_LANES = (_Lane(1), _Lane(2))
CORE, CONTEXT = range(2)


class Values:
    """Values of any strings of some bytes, from running sums of two polynomials with codes and bases of their own.

    Two different strings of ``n`` bytes agree in one with a chance of about ``n / 2**61``.
    """

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, [None, None]

    def _sums(self, lane: int) -> np.ndarray:
        if self.sums[lane] is None:
            codes, power = _LANES[lane].codes[self.data], _LANES[lane].powers("up", len(self.data))
            term = _reduced((power & _LOW32) * codes + _shifted((power >> U64(32)) * codes))
            sums = np.zeros(len(self.data) + 1, U64)
            low, high = np.cumsum(term & _LOW32, dtype=U64), np.cumsum(term >> U64(32), dtype=U64)
            sums[1:] = _reduced(_reduced(low) + _shifted(high))
            self.sums[lane] = sums
        return self.sums[lane]

    def raw(self, begin, end, lane):
        sums, back = self._sums(lane), _LANES[lane].powers("down", len(self.data) + 1)
        return product(_reduced(sums[end] + U64(_P) - sums[begin]), back[begin])

    def of(self, begin, end, salt, lane):
        return mixed(self.raw(begin, end, lane) ^ mixed(np.atleast_1d(salt).astype(U64) + U64(0x51ED27)))


def _rolled(data: np.ndarray) -> np.ndarray:
    """A value of each run of ``WINDOW`` bytes. It only chooses where phrases end, so runs that share one do no harm."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    return (sums[WINDOW:] - sums[:-WINDOW]) * powers(_BACK, len(data) + 1)[: len(data) + 1 - WINDOW]


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[Values, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of triggers, with first and last start of their strings, and the kind: 0 by a trigger, 1 by a finer one, 2 by the string itself."""
    values, n = Values(data), len(data)
    sizes = np.diff(offsets)
    starts_ok = np.zeros(n + 1, np.int8)
    long = sizes >= LENGTH
    nothing = np.zeros(0, np.int64)
    if not long.any():
        return values, nothing, nothing, nothing, nothing
    np.add.at(starts_ok, offsets[:-1][long], 1)
    np.add.at(starts_ok, offsets[1:][long] - LENGTH + 1, -1)
    rolled = _rolled(data)
    rolled ^= rolled >> U64(29)
    rolled *= U64(0xBF58476D1CE4E5B9)
    fine = np.flatnonzero(rolled < U64((1 << 64) // FINER)) + WINDOW  # ends
    owner = np.searchsorted(offsets, fine - 1, "right") - 1
    fine = fine[fine - WINDOW >= offsets[owner]]
    coarse = fine[rolled[fine - WINDOW] < U64((1 << 64) // EVERY)]
    owner = np.searchsorted(offsets, coarse - 1, "right") - 1
    low = np.maximum(offsets[owner], coarse - REACH)
    low[1:] = np.maximum(low[1:], coarse[:-1] - WINDOW + 1)
    high = np.minimum(coarse - WINDOW, offsets[owner + 1] - LENGTH)
    some = low <= high
    coarse, low, high = coarse[some], low[some], high[some]
    starts_ok[low] -= 1
    starts_ok[high + 1] += 1
    loose = np.flatnonzero(np.cumsum(starts_ok[:-1], dtype=np.int8) > 0)
    at = np.searchsorted(fine, loose + WINDOW)
    end = np.append(fine, np.iinfo(np.int64).max)[at]
    found = end <= loose + REACH
    s, e = loose[found], end[found]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (e[1:] != e[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    own = loose[~found]
    ends = np.concatenate([coarse, e[first], own])
    lows = np.concatenate([low, s[first], own])
    highs = np.concatenate([high, s[last], own]) if len(s) else np.concatenate([high, own])
    kinds = np.repeat([0, 1, 2], [len(coarse), len(first), len(own)])
    return values, ends, lows, highs, kinds


def pieces(column, starts: int):
    """``i, begin, data, offsets``: texts from the ``i``-th on, or of a longer text the bytes from ``begin`` on that hold all strings of its next ``starts`` starts.

    So a task needs no more memory for a longer text. A trigger's range of starts is cut between pieces, as it is where a text begins.
    """
    for i, j, data, offsets in parts(column, starts):
        if len(data) <= starts:
            yield i, 0, data, offsets
            continue
        for begin in range(0, len(data) - LENGTH + 1, starts):
            piece = data[begin : begin + starts + LENGTH - 1]
            yield i, begin, piece, np.array([0, len(piece)])


def _parsed(docs: DataFrame) -> DataFrame:
    """A row for each trigger: core, context, document and place (end of the trigger, distances back to its first and last start)."""

    def rows(batches):
        for batch in batches:
            for i, start, data, offsets in pieces(batch.column(2), STARTS):
                values, ends, lows, highs, kinds = triggers(data, offsets)
                if not len(ends):
                    continue
                own = kinds == 2
                begin = np.where(own, lows, ends - WINDOW)
                core = values.of(begin, np.where(own, lows + LENGTH, ends + _AFTER), kinds, CORE)
                context = values.of(lows, highs + LENGTH, ((ends - lows) << 10) + (ends - highs), CONTEXT)
                owner = np.searchsorted(offsets, lows, "right") - 1
                place = ((start + ends - offsets[owner]) << 18) + ((ends - lows) << 9) + (ends - highs)
                which = pa.array(i + owner)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(which), batch.column(1).take(which), pa.array(place)], ["core", "context", "id", "mark", "place"])

    return docs.mapInArrow(rows, _KEY)


def _repeated(rows: DataFrame, order: list[str], schema: str) -> DataFrame:
    """Rows whose core is also that of a neighbour once all are sorted by ``order``.

    Rows at the ends of a task's range are kept as well: their neighbours may be in the next range. What they hold alone is seen when cores are counted.
    """

    def neighbours(batches):
        held, alike = None, True  # the last row so far, and whether it agrees with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            core = batch.column(0).to_numpy()
            equal = core[1:] == core[:-1]
            keep = np.append(equal, False)
            keep[1:] |= equal
            keep[0] |= alike
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            held, alike = batch.slice(batch.num_rows - 1), bool(keep[-1])
        if held is not None:
            yield held

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(neighbours, schema)


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows that share their cores: the ranges that repeat as a whole, and the entries still open.

    An entry is ``single`` if it stands for one place only. Places of other entries have been found before.
    """
    shared = stored(rows, "shared")
    entries = shared.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "mark", "place", "entry")).alias("at"), F.bool_and("single").alias("single"))
    entries = stored(entries.withColumn("single", F.col("single") & (F.col("n") == 1)), "entries")
    open_cores = entries.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or("single").alias("some")).filter("kinds > 1 and some")
    tried = entries.join(open_cores.select("core"), "core", "left_semi").select("at.*", "core", "single")
    again = entries.filter("n > 1").select("core", "context")
    whole = shared.filter("single").join(again, ["core", "context"], "left_semi")
    end, far, near = F.shiftright("place", 18), F.shiftright("place", 9).bitwiseAND(511), F.col("place").bitwiseAND(511)
    return whole.select("id", "mark", (end - far).alias("begin"), (end - near + LENGTH).alias("end")), tried


def _dictionary(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """The bytes of open entries: ``id, mark, entry, bytes``. A document's entries are a list no longer than the document."""

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(2)):
                for k in range(i, j):
                    every = batch.column(3)[k].values.to_numpy()
                    text = data[offsets[k - i] : offsets[k - i + 1]].tobytes()
                    for at in range(0, len(every), ENTRIES):
                        entry = every[at : at + ENTRIES]
                        end, far, near = entry >> 18, (entry >> 9) & 511, entry & 511
                        own = [text[a:b] for a, b in zip((end - far).tolist(), (end - near + LENGTH).tolist(), strict=True)]
                        same = pa.array(np.full(len(entry), k))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(entry), pa.array(own, pa.binary())], ["id", "mark", "entry", "bytes"])

    lists = entries.groupBy("id", "mark").agg(F.collect_set("entry").alias("list"))
    return docs.join(lists, ["id", "mark"]).select("id", "mark", "text", "list").mapInArrow(rows, "id bigint, mark bigint, entry bigint, bytes binary")


def _divided(dictionary: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """Blocks of ``width`` starts of each open entry, as rows like those of the parse.

    A block's core is what all strings of a whole block share, so blocks that an entry's range cuts short still meet the others.
    """

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(6), STARTS):
                values = Values(data)
                place, entry, core = (batch.column(k).slice(i, j - i).to_numpy() for k in (2, 3, 4))
                end, far, near = place >> 18, (place >> 9) & 511, place & 511
                first, last = near // width, far // width
                count = last - first + 1
                which = np.repeat(np.arange(j - i), count)
                block = first[which] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                low, high = np.maximum(near[which], block * width), np.minimum(far[which], block * width + width - 1)
                # The trigger's place within the bytes, which begin at the first start of the whole entry.
                at = offsets[:-1][which] + ((entry >> 9) & 511)[which]
                inner = values.of(at - block * width, at - block * width - width + 1 + LENGTH, block * 1024 + width, CORE)
                inner = mixed(inner ^ core.view(np.uint64)[which])
                outer = values.of(at - high, at - low + LENGTH, high * 1024 + low, CONTEXT)
                take = pa.array(i + which)
                parted = pa.array((end[which] << 18) + (high << 9) + low)
                yield pa.RecordBatch.from_arrays([pa.array(inner.view(np.int64)), pa.array(outer.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), parted, batch.column(3).take(take), batch.column(5).take(take)], ["core", "context", "id", "mark", "place", "entry", "single"])

    both = entries.join(dictionary, ["id", "mark", "entry"]).select("id", "mark", "place", "entry", "core", "single", "bytes")
    return both.mapInArrow(rows, _BLOCK)


def spans(docs: DataFrame) -> DataFrame:
    """``id, mark, begin, end`` of passages that repeat; they may overlap. ``docs`` has the columns ``id, mark, text``."""
    parse = stored(_parsed(docs), "parse")
    order = ["core", "context", "id", "mark", "place"]
    found, tried = _level(_repeated(parse, order, _KEY).withColumn("entry", F.col("place")).withColumn("single", F.lit(True)))
    discard(parse)
    tried = stored(tried, "open")
    dictionary = stored(_dictionary(docs, tried), "dictionary")
    for width in BLOCKS:
        blocks = _divided(dictionary, tried, width)
        whole, tried = _level(_repeated(blocks, order, _BLOCK))
        found = found.union(whole)
        if width > 1:
            tried = stored(tried, "open")
    return found


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), "text", *more)


def without_repeats(docs: DataFrame, kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document, and the bytes themselves as ``kept``, if asked for."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + kept]
    found = spans(keyed(docs)).groupBy("id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    found = found.select("id", "mark", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
    joined = keyed(docs, "doc_id").join(found, ["id", "mark"], "left")

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1)):
                out = []
                for k in range(i, j):
                    text = data[offsets[k - i] : offsets[k - i + 1]]
                    begins, left, runs = batch.column(2)[k].values, text.tobytes(), 0
                    if begins is not None and len(begins):
                        begins, ends = begins.to_numpy(), batch.column(3)[k].values.to_numpy()
                        order = np.argsort(begins)
                        begins, ends = begins[order], np.maximum.accumulate(ends[order])
                        apart = begins[1:] > ends[:-1]
                        first, after = begins[np.append(True, apart)].tolist(), ends[np.append(apart, True)].tolist()
                        runs = len(first)
                        left = b"".join(left[a:b] for a, b in zip([0, *after], [*first, len(left)], strict=True))
                    out.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest(), left)[: len(names) - 1])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept
    return joined.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "begins", "ends").mapInArrow(rows, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The same without the bytes kept; stored, so that all tables on the way can go."""
    with scratch(docs.sparkSession):
        return stored(without_repeats(docs, kept=False), "digest", keep=True)
