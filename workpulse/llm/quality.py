"""Document quality by a regularised quadratic discriminant.

Each document is described by transformed statistics of its whole text. For each class the mean and covariance of these
are summed up by Spark over all labelled documents that are not held out. A class's covariance is shrunk towards the pooled one
and towards its mean variance. A score is the logistic of the difference of the two log densities, taken from
Mahalanobis distances with the Cholesky factors that the model keeps, and of the class counts.

Null texts count as empty; an empty text has statistics like any other. Labels that are null do not count; repeated rows count
as often as they stand there; a null id is not held out. Without labels of both classes the score is the share of class 1 (0.5
without labels). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workpulse.llm.storage import stored
from workpulse.llm.text import parts, shingles, word_values, words

POOLED = 0.2  # share of the pooled covariance in each class's
ROUND = 0.05  # share of the mean variance in each class's
LEAST_VARIANCE = 0.01  # that the mean variance counts as, if it is smaller: classes of one text each have none
THRESHOLD = 0.7
SOFT = 4.0  # the difference of log densities is divided by this before the logistic

_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"!?", b"|", b".,;:'\"-()", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 9
_KINDS = 10
NAMES = ("bytes", "words", "word_length", "word_spread", "distinct_words", "distinct_shingles", "repeats", "top_word", "lines", "line_words",
         "lower", "upper", "digit", "newline", "loud", "bar", "stop", "symbol", "high", "capital_words")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _distinct(values: np.ndarray, firsts: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each text, and the count of its most frequent one."""
    owner = np.repeat(np.arange(texts), np.diff(firsts))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(v)))
    top = np.zeros(texts)
    np.maximum.at(top, o[new], runs)
    return np.bincount(o[new], minlength=texts).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text, in the order of ``NAMES``."""
    texts, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(texts), size)
    kinds = np.bincount(owner * _KINDS + _CLASSES[data], minlength=texts * _KINDS).reshape(texts, _KINDS)
    starts, ends, firsts = words(data, offsets)
    values = word_values(data, starts, ends)
    count, of_word = np.diff(firsts).astype(float), np.repeat(np.arange(texts), np.diff(firsts))
    length = (ends - starts).astype(float)
    many = np.maximum(count, 1)
    mean = np.bincount(of_word, length, texts) / many
    spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, texts) / many - mean**2, 0))
    distinct, top = _distinct(values, firsts, texts)
    runs, run_firsts = shingles(values, firsts)
    distinct_runs, _ = _distinct(runs, run_firsts, texts)
    same = np.zeros(len(values))
    if len(values):
        same[1:] = (values[1:] == values[:-1]) & (of_word[1:] == of_word[:-1])
    capital = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0)
    lines = kinds[:, 4] + (size > 0)
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))  # noqa: E731  square roots spread small shares
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread),
        distinct / many, distinct_runs / np.maximum(np.diff(run_firsts), 1), share(np.bincount(of_word, same, texts), count), share(top, count),
        np.log1p(lines), np.log1p(count / np.maximum(lines, 1)),
        *(share(kinds[:, k], size) for k in (0, 1, 2, 4, 5, 6, 7, 8, 9)),
        share(np.bincount(of_word, capital, texts), count),
    ])


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, stats`` of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(2)):
                flat = pa.array(statistics(data, offsets).ravel())
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(NAMES)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), stats], ["doc_id", "held_out", "stats"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(rows, f"doc_id {kind}, held_out boolean, stats array<double>")


def _factor(covariance: np.ndarray, round_: float) -> np.ndarray:
    """Cholesky factor of a covariance with ``round_`` added to its variances; more, where rounding has left it without one."""
    while True:
        try:
            return np.linalg.cholesky(covariance + round_ * np.eye(len(covariance)))
        except np.linalg.LinAlgError:
            round_ *= 10


class Model:
    """Means, Cholesky factors and log densities' constants of the two classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        counts = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        total = sum(counts.values())
        self.share = counts[1] / total if total else 0.5
        self.classes = None
        if min(counts.values()) < 2:
            return
        mean = {c: sums[c][1] / counts[c] for c in (0, 1)}
        scatter = {c: sums[c][2] - counts[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        both = np.outer(self.scale, self.scale)
        # Without any difference between or within the classes the share of the classes is all there is to tell.
        if np.abs(mean[1] - mean[0]).max() <= 1e-9 * (1 + np.abs(mean[0]).max()) and np.trace(pooled) <= 1e-9 * (1 + mean[0] @ mean[0]):
            return
        self.classes = []
        for c in (0, 1):
            own = (1 - POOLED) * scatter[c] / counts[c] / both + POOLED * pooled / both
            factor = _factor((1 - ROUND) * own, ROUND * max(np.trace(own) / len(own), LEAST_VARIANCE))
            self.classes.append((mean[c], np.linalg.inv(factor), np.log(counts[c] / total) - np.log(np.diag(factor)).sum()))

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(stats), self.share)
        density = [constant - 0.5 * ((((stats - mean) / self.scale) @ inverse.T) ** 2).sum(1) for mean, inverse, constant in self.classes]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / SOFT, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Sum counts, statistics and their products over all labelled rows that are not held out."""
    size = len(NAMES)
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    train = stats.filter(~F.col("held_out")).join(marked, "doc_id").select("label", "stats")

    def rows(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, size)
            y = batch.column(0).to_numpy()
            for c in np.unique(y):
                own = x[y == c]
                flat = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["label", "at", "part"])

    parts_ = train.mapInArrow(rows, "label int, at int, part double")
    sums = {}
    for row in parts_.groupBy("label", "at").agg(F.sum("part").alias("part")).collect():
        sums.setdefault(row.label, np.zeros(1 + size + size * size))[row["at"]] = row.part
    return Model({c: (flat[0], flat[1 : 1 + size], flat[1 + size :].reshape(size, size)) for c, flat in sums.items()})


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document. The texts are read once; both passes use the kept statistics."""
    stats = stored(described(docs), "statistics")
    model = fit(stats, labels)

    def rows(batches):
        for batch in batches:
            score = model.score(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(score >= THRESHOLD).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
