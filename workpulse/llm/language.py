"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are counts of hashed byte trigrams and of hashed words over the whole text, A-Z lowered; their square roots are
scaled to length one. Families are told apart by one-versus-rest machines, related languages by one machine a pair and a
vote. Machines minimise the squared hinge loss by Newton steps on a bounded sample of labelled documents:
``PER_LANGUAGE`` of each language and ``SAMPLE`` in all at most (but ``LEAST`` of a language), those of the smallest hashes of id and text. The driver fits at most
``MOST_LANGUAGES`` languages, the most frequent ones; further ones, beyond what language codes name, are never predicted. Everything else covers all documents.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learned. A language outside
the family table is a family of its own. Repeated rows are scored alike; a null id is not held out. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from workpulse.llm.text import parts, tidy, utf8, word_values, words

PER_LANGUAGE = 600
SAMPLE = 3000
LEAST = 20
MOST_LANGUAGES = 500
DIM = 4096
TEXTS = 256  # whose features are held at once
STEPS = 12
COST = 8.0
UNDETERMINED = "und"
NEAREST = 0.15  # the pipeline drops documents that no family claims with this margin,
ENOUGH = 200  # if they have so many bytes that a margin tells something

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz tk ky",
    "indic": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "malayic": "id ms jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``DIM`` numbers for each text."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros((texts, DIM), np.float32)
    low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint32)
    owner = np.repeat(np.arange(texts, dtype=np.int64), np.diff(offsets))
    grams = low.copy()
    grams[1:] += low[:-1] << np.uint32(8)
    grams[2:] += low[:-2] << np.uint32(16)
    bins = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)  # the lower half of the bins
    inside = np.ones(len(data), bool)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    inside[firsts] = False
    inside[np.minimum(firsts + 1, len(data) - 1)] = False
    counts = np.bincount((owner * DIM + bins)[inside], minlength=texts * DIM)
    starts, ends, first = words(data, offsets)
    values = (word_values(data, starts, ends) >> np.uint64(53)).astype(np.int64) + DIM // 2
    counts += np.bincount(np.repeat(np.arange(texts), np.diff(first)) * DIM + values, minlength=texts * DIM)
    rows = np.sqrt(counts.reshape(texts, DIM), dtype=np.float32)
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


def fit_machine(rows: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Weights of a linear machine, the last of them its bias if the last column holds ones: Newton steps with conjugate gradients on the squared hinge loss, classes weighed alike."""
    signs = signs.astype(np.float32)
    share = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum()))
    cost = (share * COST * 10 * len(rows) ** 0.5).astype(np.float32)
    weights = np.zeros(rows.shape[1], np.float32)

    def loss(w, margins):
        return 0.5 * float(w @ w) + float((cost * np.maximum(0, 1 - margins) ** 2).sum())

    margins = signs * (rows @ weights)
    for _ in range(STEPS):
        active = margins < 1
        part, c = rows[active], cost[active]
        gradient = weights - 2 * part.T @ (c * signs[active] * (1 - margins[active]))
        if np.abs(gradient).max() < 1e-3:
            break
        step, residue = np.zeros_like(weights), -gradient
        direction, size = residue.copy(), float(residue @ residue)
        for _ in range(20):
            curved = direction + 2 * part.T @ (c * (part @ direction))
            along = np.float32(size / float(direction @ curved))
            step += along * direction
            residue = residue - along * curved
            smaller = float(residue @ residue)
            if smaller < 1e-4 * float(gradient @ gradient):
                break
            direction, size = residue + np.float32(smaller / size) * direction, smaller
        moved, scale, now = signs * (rows @ step), np.float32(1), loss(weights, margins)
        while loss(weights + scale * step, margins + scale * moved) > now and scale > 1e-4:
            scale /= np.float32(2)
        weights, margins = weights + scale * step, margins + scale * moved
    return weights


class Model:
    """Machines of the families and of the pairs of languages within each family."""

    def __init__(self, rows: np.ndarray, languages: np.ndarray):
        self.languages = sorted(set(languages.tolist()))
        families = {code: _FAMILY.get(code, f"only {code}") for code in self.languages}
        self.families = sorted(set(families.values()))
        self.members = [[i for i, code in enumerate(self.languages) if families[code] == f] for f in self.families]
        family = np.array([families[code] for code in languages.tolist()])
        fits = []
        if len(self.families) > 1:
            fits = [fit_machine(rows, np.where(family == f, 1.0, -1.0)) for f in self.families]
        self.pairs = []
        for k, members in enumerate(self.members):
            for a, b in combinations(members, 2):
                of_a, of_b = languages == self.languages[a], languages == self.languages[b]
                fits.append(fit_machine(rows[of_a | of_b], np.where(of_a[of_a | of_b], 1.0, -1.0)))
                self.pairs.append((k, a, b))
        self.weights = np.array(fits, np.float32).reshape(len(fits), DIM + 1).T

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and margin of the nearest family of each row; the margin is 1 if there is but one family."""
        margins = rows @ self.weights[:-1] + self.weights[-1]
        chance = 1 / (1 + np.exp(-4 * np.clip(margins, -20, 20)))
        n, heads = len(rows), len(self.families) if len(self.families) > 1 else 0
        family = margins[:, :heads].argmax(1) if heads else np.zeros(n, np.int64)
        votes, least = np.zeros((n, len(self.languages))), np.ones((n, len(self.languages)))
        for k, members in enumerate(self.members):
            votes[np.ix_(family == k, members)] += 1
        for at, (k, a, b) in enumerate(self.pairs, heads):
            here = family == k
            p = chance[here, at]
            votes[here, a] += (p >= 0.5) + p * 1e-3
            votes[here, b] += (p < 0.5) + (1 - p) * 1e-3
            least[here, a] = np.minimum(least[here, a], p)
            least[here, b] = np.minimum(least[here, b], 1 - p)
        best = votes.argmax(1)
        score = least[np.arange(n), best] * (chance[np.arange(n), family] if heads else 1.0)
        return best, score, margins[:, :heads].max(1) if heads else np.ones(n, np.float32)


def fit(docs: DataFrame) -> Model | None:
    """A model from a bounded sample of the documents that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Counting needs no text: texts without a letter may be counted, which only makes the sample smaller.
    counted = docs.filter(~held_out() & F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {row.lang: row["count"] for row in counted.collect()}
    if not counts:
        return None
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // len(counts)))
    shares = {lang: min(1.0, each / count) for lang, count in counts.items()}
    # Twice the share is looked at, so that the smallest hashes of each language are among them; rows that repeat id and text have one hash.
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, x in shares.items() for x in (lang, min(1.0, 2 * x))])
    near = known.withColumn("place", place).filter(F.col("place") < share[F.col("lang")] * float(1 << 30))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    sample = near.withColumn("order", order).filter(F.col("order") <= each).select("lang", "text")

    def rows(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1), texts=TEXTS):
                dense = features(data, offsets)
                for k, row in enumerate(dense):
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + k, 1), pa.array([at.astype("<u2").tobytes()]), pa.array([row[at].tobytes()])], ["lang", "bins", "counts"])

    got = sample.mapInArrow(tidy(rows), "lang string, bins binary, counts binary").toArrow()
    got = got.sort_by([("lang", "ascending"), ("bins", "ascending"), ("counts", "ascending")])
    if not got.num_rows:
        return None
    dense = np.zeros((got.num_rows, DIM + 1), np.float32)
    dense[:, DIM] = 1
    (bins, at), (counts, _) = (utf8(got[name].cast(pa.large_binary()).combine_chunks()) for name in ("bins", "counts"))
    bins, counts, at = bins.view("<u2"), counts.view(np.float32), at // 2
    for k in range(len(dense)):
        dense[k, bins[at[k] : at[k + 1]]] = counts[at[k] : at[k + 1]]
    return Model(dense, np.array(got["lang"].to_pylist(), object))


def _predicted(model: Model | None, texts, lettered) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Language, score and family margin of each text; texts too short to tell have the margin 1."""
    names, scores, near = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts))
    if model is not None:
        languages = np.array(model.languages, object)
        for i, j, data, offsets in parts(texts, texts=TEXTS):
            best, score, margin = model.predict(features(data, offsets))
            names[i:j], scores[i:j], near[i:j] = languages[best], score, np.where(np.diff(offsets) < ENOUGH, 1, margin)
        none = ~lettered.fill_null(False).to_numpy(zero_copy_only=False)
        names[none], scores[none] = UNDETERMINED, 0.0
    return pa.array(names, pa.string()), pa.array(scores, pa.float64()), near


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document."""

    def rows(batches):
        for batch in batches:
            names, scores, _ = _predicted(model, batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, scores], ["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select("doc_id", held_out().alias("held_out"), "text", F.col("text").rlike(r"\p{L}"))
    return read.mapInArrow(tidy(rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None, nearest: float = NEAREST) -> DataFrame:
    """The documents of some language, columns as they are: those with a letter that a family claims with a margin of ``nearest`` at least.

    A typical document has a margin of 1; near 0 its family's machine cannot tell it from the others, as with texts of no learned language.
    Texts of fewer than ``ENOUGH`` bytes stay, since they tell too little to be rejected by. Where nothing could be learned, or but one family, there
    is nothing to reject by, and every document with a letter stays.
    """
    names, text = docs.columns, docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            lettered = batch.column(len(names))
            _, _, near = _predicted(model, batch.column(text), lettered)
            good = lettered.fill_null(False).to_numpy(zero_copy_only=False) & (near >= nearest)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], schema=pa.schema(list(batch.schema)[: len(names)])).filter(pa.array(good))

    return docs.select("*", F.col("text").rlike(r"\p{L}")).mapInArrow(tidy(rows), docs.schema)
