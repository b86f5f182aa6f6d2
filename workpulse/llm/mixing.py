"""Mixing sources to target weights by Pareto order sampling.

A document is expected to give copies in proportion to the fourth root of its words, so longer texts of a source come in somewhat more often; the factor
of a source, its rate, is the one at which the words expected meet its target, and no document is expected more than ``LIMIT`` times. The whole
part of a document's copies is certain and is allocated at once. The rest is its inclusion chance ``p``: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``, their random odds over their inclusion odds, and the lowest ranks are taken until
the source has its words. The sample's size is fixed in words, not in documents, because targets are in words.

No source is gathered in one task. The rank at which a source stops is found by two histograms (`FINE` bins of the rank, then
`FINE` bins within one bin) and an exact order over the few documents of the last bin.

Nulls, ties and odd input: a null text has size 0; null is a source of its own, the last one; documents of size 0 are
taken as those of one word are but give no words; rows that agree in id and text tie and are taken together; a null id
counts as an empty one; an empty table gives no rows. Columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from workpulse.llm.storage import stored
from workpulse.operators.ranking import with_position

WEIGHTS = (3, 1, 2)  # of the sources in code-point order, repeating
SHARE = 1.5  # of all words, shared out by the weights
LIMIT = 2  # a target is at most so many times its source's size
SEED = "mix"
PULL = 1 << 16  # parts of one of a fourth root
FINE = 1024
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """Source, id and number of words of each document, with a random number in (0, 1) that its id and text fix."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    drawn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return docs.select("source", "doc_id", size.alias("size"), ((drawn + 0.5) / F.lit(float(1 << 48))).alias("u"), *more)


def targets(sizes: DataFrame) -> DataFrame:
    """Target of each source: its weight's part of the share, with what lies above a limit reshared until none does.

    The level is found by repeated sums over the sources; each step adds sources that stop at their limit.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    last = per_source.withColumn("last", F.col("source").isNull().cast("int"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS)).cast("int"))
    weighed = stored(with_position(last, "last", "source", descending=False, name="place").select("source", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size") * F.lit(LIMIT)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stopped = F.col("weight") * F.lit(level) >= limit
        full, weights = weighed.agg(F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not weights:
            break
        higher = (total * SHARE - (full or 0)) / weights
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def _pull(size):
    """Whole number in proportion to the fourth root of a document's words."""
    return F.floor(F.sqrt(F.sqrt(F.greatest(size, F.lit(1)).cast("double"))) * F.lit(float(PULL))).cast("bigint")


def _expected(size):
    """Copies that a document is expected to give. A source without a rate is taken ``LIMIT`` times as a whole."""
    some = F.when(F.col("rate").isNull(), F.lit(float(LIMIT))).otherwise(F.least(F.lit(float(LIMIT)), F.col("rate") * _pull(size)))
    return F.when(F.col("source_size") > 0, some).otherwise(F.lit(0.0))


def shares_of(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target, rate, certain`` of each source; certain are the words of whole copies.

    The rate is found over the distinct sizes of a source, largest first: those before the first size that the rate leaves below the limit are at the limit.
    """
    wanted = targets(sizes)
    of_size = sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    both = of_size.join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    words, pulled = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("decimal(19,0)") * _pull(F.col("size")).cast("decimal(12,0)")
    whole = Window.partitionBy("source")
    larger = whole.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)
    stopped = F.coalesce(F.sum(words).over(larger), nothing) * LIMIT
    free = F.sum(pulled).over(whole) - F.coalesce(F.sum(pulled).over(larger), nothing)
    tried = both.withColumn("try", (F.col("target") - stopped.cast("double")) / free.cast("double"))
    fits = F.col("try") * _pull(F.col("size")) < LIMIT
    rated = tried.withColumn("rate", F.max_by(F.when(fits, F.col("try")), F.when(fits, F.col("size"))).over(whole))
    certain = F.sum(words * F.floor(_expected(F.col("size"))).cast("bigint"))
    rates = rated.groupBy("source").agg(F.max("rate").alias("rate"), certain.alias("certain"))
    found = wanted.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    return found.select("source", "source_size", "target", "rate", F.coalesce("certain", nothing).alias("certain"))


def _ranked(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """Each document with its source's shares, its whole copies, its Pareto rank and the bins of that rank."""
    both = sizes.join(shares.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = both.withColumn("expected", _expected(F.col("size"))).withColumn("whole", F.floor("expected"))
    chance = F.col("expected") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    ranked = expected.withColumn("rank", F.when(chance > 0, odds))
    spread = F.floor(F.col("rank") / (F.col("rank") + 1) * F.lit(float(FINE * FINE))).cast("bigint")
    return ranked.withColumn("bin", F.least(spread, F.lit(FINE * FINE - 1)))


def _crossing(bins: DataFrame, bin_column: str) -> DataFrame:
    """The first bin of each source in which its words reach what it wants, with the words before that bin."""
    along = Window.partitionBy("source").orderBy(bin_column)
    reached = bins.withColumn("upto", F.sum("words").over(along)).withColumn("upto", F.col("upto") + F.col("start"))
    crossed = reached.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("words") < F.col("wanted")))
    return crossed.select("source", bin_column, (F.col("upto") - F.col("words")).alias("start"))


def cuts(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """For each source that samples: the bin at which it stops, and the last rank and id that it takes within that bin."""
    wanted = F.col("target") - F.col("certain")
    ranked = _ranked(sizes, shares).filter("rank is not null").withColumn("wanted", wanted).withColumn("coarse", F.floor(F.col("bin") / FINE))
    first = ranked.groupBy("source", "coarse").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.lit(0).cast("bigint").alias("start"))
    at = stored(_crossing(first, "coarse"), "cut")
    same = lambda one, other, name: one[name].eqNullSafe(other[name])
    inside = ranked.join(at, same(ranked, at, "source") & (ranked["coarse"] == at["coarse"])).select(ranked["*"], at["start"])
    second = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("start").alias("start"))
    at = stored(_crossing(second, "bin"), "cut")
    final = ranked.join(at, same(ranked, at, "source") & (ranked["bin"] == at["bin"])).select(ranked["*"], at["start"])
    # Rows that tie in rank and id are peers of the running sum, so they are taken together.
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id"))
    peers = F.sum("size").over(Window.partitionBy("source", "rank", "doc_id"))
    short = F.col("upto") - F.col("peers") < F.col("wanted")  # else the words were there already
    near = short & (F.abs(F.col("upto") - F.col("wanted")) <= F.abs(F.col("upto") - F.col("peers") - F.col("wanted")))
    summed = final.withColumn("upto", upto + F.col("start")).withColumn("peers", peers)
    taken = F.when(near, F.struct(F.col("rank"), F.col("doc_id")))
    return stored(summed.groupBy("source").agg(F.max("bin").alias("stop"), F.max(taken).alias("last")), "cut")


def decided(rows: DataFrame, shares: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with its sources' sizes and targets, and the copies that the mix takes of each; rows are not shuffled."""
    ends = ends.select(F.col("source").alias("_source"), "stop", "last", F.lit(True).alias("ends"))
    joined = _ranked(rows, shares).join(ends, F.col("source").eqNullSafe(F.col("_source")), "left")
    here = F.struct(F.col("rank"), F.col("doc_id"))
    chosen = (F.col("bin") < F.col("stop")) | ((F.col("bin") == F.col("stop")) & F.coalesce(here <= F.col("last"), F.lit(False)))
    # Without a stop the source's documents do not reach what it wants, so all of them are taken.
    more = F.when(F.col("rank").isNull(), 0).when(F.col("ends").isNull(), 1).otherwise(F.coalesce(chosen, F.lit(False)).cast("int"))
    return joined.withColumn("copies", (F.col("whole") + more).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """Digest of the mix: ``doc_id, size, source_size, target, taken, copies``, a row for each document."""
    sizes = stored(sized(docs), "sizes")
    shares = stored(shares_of(sizes), "shares")
    words = (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    return decided(sizes, shares, cuts(sizes, shares)).select("doc_id", "size", "source_size", "target", words, "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sizes = stored(sized(docs), "sizes")
    shares = stored(shares_of(sizes), "shares")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    chosen = decided(sized(docs, row), shares, cuts(sizes, shares)).filter("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
