"""Near-duplicate documents by a MinHash LSH forest and exact confirmation.

A document's set is its distinct five-word shingles; documents with equal sets are one class, named by its smallest id, and only classes go on.
A signature of ``TREES * DEPTH`` minima gives ``TREES`` orders: each tree sorts all classes by its own ``DEPTH`` minima. Neighbours in an order
that share a prefix of `FIRST` minima at least are candidates. Each class first tries the neighbours with which it shares most, which joins
large groups at little cost.

The rest is found region by region. A region is a run of classes with a common prefix. Within it only classes outside its
largest component can have a link that still matters, and they are tried against every class of the region. A region in which more
than ``OUTSIDE`` classes lie outside is taken deeper, along ``DEPTHS``, until its parts are small enough; at the last depth everything is tried.
New links bring components together, so regions that were taken deeper are tried again until no new link appears.

What is still crowded then are families of texts that share much, but mostly too little. Their classes are joined on their rarest shingles, without
regard to regions: two sets that are to be linked have one in common among the first of both in an order of all shingles (`_rarest`), so no such
pair is left out. There is no cap on partners anywhere.

A pair is tried by sketch first, `SKETCH` minima of one byte each: less than ``LIKELY`` of them agree for a pair that is to be linked with a chance of
about 4e-6. What passes is confirmed on full sets. Two sets of Jaccard similarity 0.75 share a prefix of three minima in one of 20 trees with
probability 1 - (1 - 0.75**3)**20, about 0.99998, and a component needs only one chain of links.

Nulls, ties and odd input: null or empty texts and texts without words have an empty set and are linked with nothing; rows without an id are kept
and belong to no component; rows that share an id but hold different sets are of different classes, and each row has the component of its own
text. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from workpulse.llm.components import components
from workpulse.llm.storage import scratch, stored
from workpulse.llm.text import mixed, parts, shingles, tidy, word_values, words

TREES, DEPTH, FIRST = 20, 5, 3
DEPTHS = (3, 5, 8, 13, 20)  # minima that a region's classes share, from shallow to deep
OUTSIDE = 32
TRIED = 2  # partners that a class tries at once
SIMILARITY = 75  # per cent of the union
SKETCH = 256
SENT = 1_000_000  # ids or shingles that may go to every task, of 8 or 16 bytes
LIKELY = 161  # of the sketch; 4.5 standard deviations below what pairs of the least similarity share
COMMON = 1000  # a shingle that so many classes hold, or one in so many of all, is a common one
BEFORE = 64  # shingles before a shared one that are looked at; a pair that shares only earlier ones besides is made again, and counts once
SPREAD = 1 << 18  # shingles that are counted or spread out at once
BUCKET = 1 << 20  # distinct shingles that are counted in one piece, about
_EXTRA = SKETCH - TREES * DEPTH
_WIDE = 4  # bytes of a minimum
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# ---- Sets and signatures of many texts -------------------------------------------------------------------------------


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and the index of each text's first one."""
    starts, ends, firsts = words(data, offsets)
    values, first = shingles(word_values(data, starts, ends), firsts)
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(texts + 1))


def signatures(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """``SKETCH`` minima for each text that has a set; the first ``TREES * DEPTH`` are its signature."""
    begins = firsts[:-1][np.diff(firsts) > 0]
    small = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SKETCH, len(begins)), np.uint32)
    for k in range(SKETCH) if len(begins) else ():
        shuffled = (small ^ _XOR[k]) * _TIMES[k]
        shuffled ^= shuffled >> np.uint32(16)
        np.minimum.reduceat(shuffled, begins, out=out[k])
    return out.T


def _names(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Two numbers for each text that name its set; 0 for an empty one."""
    some = np.diff(firsts) > 0
    names = np.zeros((2, len(some)), np.uint64)
    for k in range(2):
        if some.any():
            names[k, some] = np.add.reduceat(mixed(values + np.uint64(k + 1)), firsts[:-1][some])
    return names.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, low, high, signature, extra``; low and high name the set, extra is the rest of its sketch."""

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1)):
                values, firsts = sets(data, offsets)
                count = np.diff(firsts)
                some = count > 0
                names = _names(values, firsts)
                signature, extra = np.full(j - i, None, object), np.full(j - i, None, object)
                minima = signatures(values, firsts)
                signature[some] = [row.tobytes() for row in np.ascontiguousarray(minima[:, : TREES * DEPTH]).astype(">u4")]
                extra[some] = [row.tobytes() for row in minima[:, TREES * DEPTH :].astype(np.uint8)]
                columns = [batch.column(0).slice(i, j - i), pa.array(count.astype(np.int64)), *(pa.array(x) for x in names), pa.array(signature, pa.binary()), pa.array(extra, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "low", "high", "signature", "extra"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(rows), "doc_id bigint, n_shingles bigint, low bigint, high bigint, signature binary, extra binary")


# ---- Candidates ------------------------------------------------------------------------------------------------------


def _members(classes: DataFrame) -> DataFrame:
    """Classes of each tree that share a prefix with a neighbour in its order: ``tree, key, rep, n, next, next_n``.

    The order is a sort over all classes, dealt out by ranges of (tree, key, id), so a region of any size spans tasks. Rows at the ends
    of a task's range are always kept: whether their region goes on is seen later, when regions are put together.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    spread = classes.select("rep", F.col("n_shingles").alias("n"), "signature", tree)
    forest = spread.select("tree", F.substring("signature", F.col("tree") * (DEPTH * _WIDE) + 1, F.lit(DEPTH * _WIDE)).alias("key"), "rep", "n")

    def rows(batches):
        held, before = None, True  # the last row so far, and whether it shares a prefix with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            size = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(size, DEPTH)
            tree = batch.column(0).to_numpy()
            common = np.cumprod((keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None], 1).sum(1)
            near = common >= FIRST
            keep = np.append(near, False)
            keep[1:] |= near
            keep[0] |= before
            yield _with_next(batch, near, keep, size - 1)
            held, before = batch.slice(size - 1), bool(keep[-1])
        if held is not None:
            yield _with_next(held, np.zeros(0, bool), np.ones(1, bool), 1)

    ordered = forest.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    return ordered.mapInArrow(tidy(rows), "tree int, key binary, rep bigint, n bigint, next bigint, next_n bigint")


def _with_next(batch, near, keep, upto):
    """The first ``upto`` rows that are kept, with their next neighbours where these are near."""
    nothing = np.zeros(batch.num_rows, bool)
    nothing[: len(near)] = near
    rep, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    following = [pa.array(np.append(x[1:], 0), pa.int64(), mask=~nothing) for x in (rep, n)]
    out = pa.RecordBatch.from_arrays([*batch.columns, *following], ["tree", "key", "rep", "n", "next", "next_n"])
    mask = keep.copy()
    mask[upto:] = False
    return out.filter(pa.array(mask))


def _similar_size(a: str, b: str):
    """Sets whose sizes differ more than this cannot be linked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def _neighbours(members: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of neighbours."""
    near = members.filter("next is not null and next <> rep").filter(_similar_size("n", "next_n"))
    return near.select(F.least("rep", "next").alias("a"), F.greatest("rep", "next").alias("b")).distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b")


def _best(pairs: DataFrame) -> DataFrame:
    """For each class the ``TRIED`` partners it shares most with. A class has two neighbours a tree at most."""
    ends = pairs.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("end"))
    place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("shared"), "a", "b"))
    return ends.withColumn("place", place).filter(F.col("place") <= TRIED).select("a", "b").distinct()


def _sketches(reps: DataFrame) -> DataFrame:
    """``rep, n, sketch`` of classes."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                low = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[:, _WIDE - 1 :: _WIDE]
                rest = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                whole = np.hstack([low, rest])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in whole], pa.binary())], ["rep", "n", "sketch"])

    return reps.select("rep", F.col("n_shingles").alias("n"), "signature", "extra").mapInArrow(tidy(rows), "rep bigint, n bigint, sketch binary")


def _bytes(column) -> np.ndarray:
    """Rows of a binary column whose values are all ``SKETCH`` long."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches agree, with the number of minima that do in ``shared``."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                shared = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared)], ["a", "b", "shared"]).filter(pa.array(shared >= LIKELY))

    one = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    other = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(tidy(rows), "a bigint, b bigint, shared bigint")


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``a, b, linked`` of each pair, from the full sets."""

    def rows(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked[k] = 100 * common >= SIMILARITY * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    one = full.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    other = full.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(tidy(rows), "a bigint, b bigint, linked boolean")


# ---- Regions ---------------------------------------------------------------------------------------------------------


def _places(members: DataFrame, reps: DataFrame) -> DataFrame:
    """The regions of each member in each of its trees: ``rep, regions``, from shallow to deep, each by a hash of tree and prefix.

    Past its own minima a tree goes on with those of the trees after it.
    """
    turned = F.substring(F.concat("signature", "signature"), F.col("tree") * (DEPTH * _WIDE) + 1, F.lit(DEPTHS[-1] * _WIDE))
    regions = F.array(*[F.xxhash64("tree", F.substring("turned", 1, depth * _WIDE)) for depth in DEPTHS])
    return members.select("tree", "rep").join(reps.select("rep", "signature"), "rep").withColumn("turned", turned).select("rep", regions.alias("regions"))


def _across(places: DataFrame, sketches: DataFrame, labels: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likely pairs of all regions that still matter and are not done, these regions, and the places whose shallow regions were too crowded."""
    labelled = places.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("_c")), "rep", "left")
    rows = labelled.select("rep", F.coalesce("_c", "rep").alias("component"), "regions", F.posexplode("regions").alias("depth", "region"))
    rows = rows.withColumn("parent", F.get("regions", F.col("depth") - 1)).drop("regions")
    sizes = rows.groupBy("region", "depth", "component").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"))
    regions = sizes.groupBy("region", "depth").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.first("parent").alias("parent"))
    outside = F.col("all") - F.col("main.n")
    regions = stored(regions.filter("kinds > 1").select("region", "depth", "parent", F.col("main.component").alias("main"), outside.alias("outside")), "regions")
    # A region is tried at the first depth at which few enough classes lie outside.
    crowded = regions.filter(F.col("outside") > OUTSIDE).select(F.col("region").alias("_crowded"))
    small = regions.filter((F.col("outside") <= OUTSIDE) | (F.col("depth") == len(DEPTHS) - 1))
    small = small.join(crowded, F.col("parent") == F.col("_crowded"), "left").filter("depth = 0 or _crowded is not null")
    small = small.select("region", "main", "outside")
    small = stored(small if done is None else small.join(done, "region", "left_anti"), "tried")
    inside = stored(rows.select("rep", "component", "region").join(small, "region").join(sketches, "rep"), "inside")
    # Those outside go in packs of a bounded size to every row of their region.
    pack = F.pmod(F.xxhash64("rep"), F.ceil(F.col("outside") / OUTSIDE))
    packs = inside.filter("component <> main").groupBy("region", pack.alias("pack")).agg(F.collect_list(F.struct("rep", "component", "n", "sketch")).alias("tried"))

    def pairs(batches):
        for batch in batches:
            sketch = _bytes(batch.column(3)) if batch.num_rows else None
            for k in range(batch.num_rows):
                rep, component, n = (batch.column(c)[k].as_py() for c in range(3))
                tried = batch.column(4)[k].values
                other, theirs, size = (tried.field(c).to_numpy() for c in range(3))
                good = (theirs != component) & (np.minimum(size, n) * 100 >= np.maximum(size, n) * SIMILARITY)
                if good.any():
                    good &= (_bytes(tried.field(3)) == sketch[k]).sum(1) >= LIKELY
                    found = other[good]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, rep)), pa.array(np.maximum(found, rep))], ["a", "b"])

    met = inside.select("region", "rep", "component", "n", "sketch").join(packs.select("region", "tried"), "region").drop("region")
    found = met.mapInArrow(tidy(pairs), "a bigint, b bigint").filter("a < b").distinct()
    return found, small, places.join(crowded, F.get("regions", F.lit(0)) == F.col("_crowded"), "left_semi")


# ---- Crowded families ------------------------------------------------------------------------------------------------


def _least(n):
    """Shingles that a set of ``n`` shares at least with a set it is linked with."""
    return F.ceil(n * SIMILARITY / F.lit(100))


def _chunks(batch):
    """Runs ``start, end, sets`` of a batch's classes with `SPREAD` shingles together at most, or one class with more."""
    sets_of = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
    start = 0
    while start < len(sets_of):
        end, size = start, 0
        while end < len(sets_of) and (end == start or size + len(sets_of[end]) <= SPREAD):
            size += len(sets_of[end])
            end += 1
        yield start, end, sets_of[start:end]
        start = end


def _counted(shingle, times, low, high):
    """Each shingle once, with the sum of its ``times`` and the least and greatest component that holds it."""
    order = np.argsort(shingle, kind="stable")
    shingle, times, low, high = (x[order] for x in (shingle, times, low, high))
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
    if not len(first):
        return shingle, times, low, high
    return shingle[first], np.add.reduceat(times, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _held(own: DataFrame) -> DataFrame:
    """``shingle, times`` of the shingles that classes of several components hold.

    Tasks count the shingles of a chunk and send them packed, one row for each bucket of shingles, so a shingle that very many classes hold
    is one entry a chunk.
    """
    total = own.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    buckets = max(16, total // 8 // BUCKET)

    def packed(batches):
        for batch in batches:
            for start, end, sets_of in _chunks(batch):
                n = np.array([len(x) for x in sets_of], np.int64)
                component = np.repeat(batch.column(1).to_numpy()[start:end], n)
                counted = _counted(np.concatenate(sets_of), np.ones(int(n.sum()), np.int64), component, component)
                bucket = (counted[0].view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                names, firsts = np.unique(bucket[order], return_index=True)
                bounds = np.append(firsts, len(order)).tolist()
                entries = np.stack(counted)[:, order]
                bytes_ = [np.ascontiguousarray(entries[:, a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(bytes_, pa.binary())], ["bucket", "entries"])

    def merged(batches):
        def shared(counted):
            several = counted[2] != counted[3]
            return pa.RecordBatch.from_arrays([pa.array(counted[0][several]), pa.array(counted[1][several])], ["shingle", "times"])

        open_, parts_, size = None, [], 0
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != open_ and parts_:
                    yield shared(_counted(*np.concatenate(parts_, 1)))
                    parts_, size = [], 0
                open_ = bucket
                parts_.append(np.frombuffer(entries.as_buffer(), np.int64).reshape(4, -1))
                size += parts_[-1].shape[1]
                if size > 4 * BUCKET:
                    parts_ = [np.stack(_counted(*np.concatenate(parts_, 1)))]
                    size = parts_[0].shape[1]
        if parts_:
            yield shared(_counted(*np.concatenate(parts_, 1)))

    sent = own.mapInArrow(tidy(packed), "bucket bigint, entries binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(merged), "shingle bigint, times bigint")


def _first_told(own: DataFrame, held: DataFrame) -> DataFrame:
    """``shingle, rep, component, n, place`` of each class's shingles that may be the first it shares, by ``held``, which every task gets: `SENT` rows at most."""
    table = held.toArrow()
    known = table["shingle"].to_numpy()
    order = np.argsort(known)
    known, times = known[order], table["times"].to_numpy()[order]

    def rows(batches):
        for batch in batches:
            out = []
            for k, held_ in enumerate(batch.column(2)):
                own_ = np.frombuffer(held_.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(known, own_), max(0, len(known) - 1))
                at = at[known[at] == own_] if len(known) else at[:0]
                at = at[np.lexsort((known[at], times[at]))]
                n = len(own_)
                place = n - len(at) + 1 + np.arange(len(at))
                at, place = (x[place <= n - -(-n * SIMILARITY // 100) + 1] for x in (at, place))
                out.append((known[at], np.full(len(at), k), np.full(len(at), n), place))
            if out:
                shingle, which, n, place = (np.concatenate(x) for x in zip(*out, strict=True))
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), batch.column(0).take(which), batch.column(1).take(which), pa.array(n), pa.array(place)], ["shingle", "rep", "component", "n", "place"])

    return own.mapInArrow(tidy(rows), "shingle bigint, rep bigint, component bigint, n bigint, place bigint")


def _first_joined(own: DataFrame, held: DataFrame, reps: DataFrame) -> DataFrame:
    """The same, whatever the number of shingles that are held."""

    def rows(batches):
        for batch in batches:
            for start, end, sets_of in _chunks(batch):
                n = np.array([len(x) for x in sets_of], np.int64)
                ids = [pa.array(np.repeat(batch.column(c).to_numpy()[start:end], n)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets_of))], ["rep", "component", "n", "shingle"])

    spread = stored(own.mapInArrow(tidy(rows), "rep bigint, component bigint, n bigint, shingle bigint"), "spread")
    # Mostly so few shingles are common that every task can have them; then no task gets all rows of one.
    common = F.col("times") > max(COMMON, reps.count() // COMMON)
    often = held.filter(common)
    often = F.broadcast(often) if often.count() <= SENT else often
    several = spread.join(held.filter(~common), "shingle").unionByName(spread.join(often, "shingle"))
    whole = Window.partitionBy("rep")
    place = F.col("n") - F.count(F.lit(1)).over(whole) + F.row_number().over(whole.orderBy("times", "shingle"))
    first = several.withColumn("place", place).filter(F.col("place") <= F.col("n") - _least(F.col("n")) + 1)
    return first.select("shingle", "rep", "component", "n", "place")


def _rarest(crowded: DataFrame, full: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pair ``a < b`` of different components among the classes of crowded regions that can be linked by its rarest shingles.

    All shingles stand in one order: first those that only one component holds, which no pair shares, then from rare to common. Sets of ``x``
    and ``y`` shingles that are linked share ``o = 0.75 / 1.75 * (x + y)`` at least, so the first that they share stands at a place up to ``x - o + 1`` in
    one and up to ``y - o + 1`` in the other.
    """
    component = labels.select(F.col("node").alias("rep"), F.col("component").alias("_c"))
    reps = stored(crowded.select("rep").distinct().join(component, "rep", "left").select("rep", F.coalesce("_c", "rep").alias("component")), "families")

    own = full.join(reps, "rep").select("rep", "component", "shingles")
    held = stored(_held(own), "held")
    first = stored(_first_told(own, held) if held.count() <= SENT else _first_joined(own, held, reps), "first")
    # Of each shingle's holders, those outside its largest component are tried against all.
    sizes = first.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("kinds"))
    main = stored(main.filter("kinds > 1").select("shingle", F.col("main.component").alias("main")), "main")
    # A pair is made where it first shares a shingle: not where some shingle before it, of those that several components hold, is in both.
    before = Window.partitionBy("rep").orderBy("place").rowsBetween(-BEFORE, -1)
    ours = stored(first.join(main, "shingle").withColumn("before", F.collect_list("shingle").over(before)), "shared")
    outside = ours.filter("component <> main").select("shingle", *[F.col(c).alias(f"_{c}") for c in ("rep", "component", "n", "place", "before")])
    both = outside.join(ours.drop("main"), "shingle").filter("component <> _component").filter(_similar_size("n", "_n")).filter(~F.arrays_overlap("before", "_before"))
    shared = F.ceil((F.col("n") + F.col("_n")) * SIMILARITY / F.lit(100 + SIMILARITY))
    both = both.filter((F.col("place") + shared <= F.col("n") + 1) & (F.col("_place") + shared <= F.col("_n") + 1))
    return both.select(F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b")).distinct()


# ---- The operator ----------------------------------------------------------------------------------------------------


def _sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, shingles`` of classes: the texts of their smallest ids, of which those that hold the class's set count."""

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(3)):
                values, firsts = sets(data, offsets)
                low, high = _names(values, firsts)
                own = (low == batch.column(1).to_numpy()[i:j]) & (high == batch.column(2).to_numpy()[i:j])
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([values[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())], ["rep", "shingles"])
                yield out.filter(pa.array(own))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    rows_of = texts.join(reps.select("rep", "id", "low", "high"), "id").select("rep", "low", "high", "text")
    full = stored(rows_of.mapInArrow(tidy(rows), "rep bigint, shingles binary"), "sets")
    return full if full.count() == reps.count() else stored(full.dropDuplicates(["rep"]), "sets")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, component`` after more links."""
    if labels is None:
        return components(links)
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    moved = components(between)
    known = labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    return stored(known.select("node", F.coalesce("to", "component").alias("component")).union(fresh.select("node", "component")), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document."""
    with scratch(docs.sparkSession):
        return stored(_near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept"), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document, the name of its set, and whether it ``stands`` for its component."""
    signed = stored(_signed(docs), "signed")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(named.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("id"), F.first(F.struct("signature", "extra")).alias("s")).select("low", "high", "n_shingles", "id", F.col("id").alias("rep"), "s.*"), "classes")
    # Classes are named by their smallest id; of several with the same one, those after the first by a hash of their set.
    again = classes.groupBy("id").agg(F.min(F.struct("low", "high")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = stored(again.select("id", "_first"), "again")
    shared = not again.isEmpty()
    if shared:
        later = F.col("_first") != F.struct("low", "high")
        named_again = F.when(later, F.xxhash64("low", "high")).otherwise(F.col("id")).alias("rep")
        classes = stored(classes.drop("rep").join(again, "id", "left").select("low", "high", "n_shingles", "id", named_again, "signature", "extra"), "classes")
    members = stored(_members(classes), "members")
    reps = stored(classes.join(members.select("rep").distinct(), "rep", "left_semi"), "reps")
    full = _sets_of(docs, reps)
    sketches = stored(_sketches(reps), "sketches")
    places = stored(_places(members, reps), "places")
    neighbours = stored(_likely(_neighbours(members), sketches), "neighbours")
    tested = stored(_confirmed(_best(neighbours), full), "tested")
    labels = _merged(None, tested.filter("linked"))
    rest = neighbours.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = stored(_confirmed(_between(rest, labels), full), "tested")
    labels = _merged(labels, more.filter("linked"))
    tested = tested.union(more)
    done = None
    while True:
        pairs, tried, crowded = _across(places, sketches, labels, done)
        if done is not None and tried.isEmpty():
            break
        more = stored(_confirmed(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), full), "tested")
        links = more.filter("linked")
        if links.isEmpty():
            break
        labels = _merged(labels, links)
        # Regions that were tried are done for good; crowded ones have fewer components now.
        done = tried.select("region") if done is None else done.union(tried.select("region"))
        tested = tested.union(more)
        places = stored(crowded, "places")
        if places.isEmpty():
            break
    crowded = stored(crowded, "crowded")
    if not crowded.isEmpty():
        likely = _likely(_rarest(crowded, full, labels).join(tested.select("a", "b"), ["a", "b"], "left_anti"), sketches)
        labels = _merged(labels, stored(_confirmed(likely, full), "tested").filter("linked"))
    ends = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if shared:
        ends = stored(ends.select("low", "high", "n_shingles", "id", "component"), "ends")
        main = ends.groupBy("component").agg(F.min(F.struct("id", "low", "high")).alias("m"))
        ends = ends.join(main, "component").withColumn("own", F.col("m") == F.struct("id", "low", "high")).withColumn("component", F.col("m.id"))
    else:
        ends = ends.withColumn("own", F.col("rep") == F.col("component"))
    ends = ends.select("low", "high", "n_shingles", "component", "own")
    joined = signed.select("doc_id", "n_shingles", "low", "high").join(ends, ["low", "high", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"), "low", "high", F.coalesce("own", F.lit(True)).alias("own"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.withColumn("stands", F.col("kept") & F.col("own"))


def _unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to be none of ``columns``."""
    taken = {column.lower() for column in columns}
    return [next(name + "_" * k for k in range(len(taken) + 1) if (name + "_" * k).lower() not in taken) for name in names]


def _named(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with the name of each text's set in two further columns."""
    text = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(text)):
                of_sets = [pa.array(x) for x in _names(*sets(data, offsets))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *of_sets], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, T.LongType()) for name in names]])
    return docs.mapInArrow(tidy(rows), schema)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, columns as they are; rows that repeat a kept id and set go too. Rows without an id stay.

    Rows that share an id are decided one by one, by their sets; the smallest text of an id and set is kept.
    Up to ``SENT`` ids that go are sent to every task, so the texts are not shuffled; more of them are joined by a shuffle.
    """
    with scratch(docs.sparkSession):
        found = stored(_near_duplicates(docs).select("doc_id", "low", "high", "stands").filter("doc_id is not null"), "near-duplicates", keep=True)
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or("stands").alias("_kept"), (F.count(F.lit(1)) > 1).alias("_again"))
    ids = stored(ids, "kept")
    gone = ids.filter("not _kept").select("_id")
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    out = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    again = ids.filter("_kept and _again").select("_id")
    if again.isEmpty():
        return out
    low, high, place = _unused(docs.columns, "set_low", "set_high", "place")
    several = _named(out.join(again, out["doc_id"] == again["_id"], "left_semi"), [low, high])
    stands = found.filter("stands").select(F.col("doc_id").alias("_id"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    same = (several["doc_id"] == stands["_id"]) & (several[low] == stands["_low"]) & (several[high] == stands["_high"])
    order = Window.partitionBy("doc_id", low, high).orderBy("text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    once = several.join(stands, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return out.join(again, out["doc_id"] == again["_id"], "left_anti").unionByName(once.select(*[F.col(f"`{c}`") for c in docs.columns]))
