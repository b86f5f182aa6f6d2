"""Alignment of two tokenizers over a corpus: which ids of one meet which of the other, and how often.

A text is encoded by a byte-level vocabulary (A, over a space and the text) and by a sentencepiece model (B, over the text, which adds the
space itself). Both give runs of bytes; offsets where tokens of both end cut them into groups, and a link is a pair of token occurrences whose bytes overlap.

An array made once maps each id of A to the id of B with the same bytes. A group of one token each that this array foretells is
counted in a vector as long as the vocabulary. Only the other links become (A id, B id) pairs: each chunk of texts counts its distinct
pairs, these are shuffled and summed over the corpus, and each chunk gets back the counts of its own pairs. The vectors and the
best count of each id of B are no longer than a vocabulary, whatever the corpus, so they go to every task.

The links of a chunk wait in a file of the shared folder, as ids for the vector and as places among the chunk's sorted pairs. Files carry the
name of their attempt, and only those that the finished attempt reports are read.

A text that is null, empty or whose bytes do not come back from both tokenizers has no tokens: its counts are 0 and its digest is empty.
Repeated rows and null or repeated ids are rows like others. An empty table gives an empty result. Further columns are not read. The tokens of
one text are held at once, texts beyond that in slices of 512 KB.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from workpulse.llm.storage import file_system, new_folder, scratch, stored
from workpulse.llm.text import slices, tidy, utf8

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 24  # bytes of text whose pairs are counted together
MOST_TASKS = 10_000  # that read chunks back; beyond, a task reads several
SHIFT = 32  # a pair is A id << 32 | B id
SPACE = "▁"
BLANK = 50_000  # characters of white space in a row
_BLANK = re.compile(rf"\s{{{BLANK}}}")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# How the byte-level vocabulary cuts a text before merging; a fixed value of its public format.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---- Vocabularies ----------------------------------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteVocabulary:
    """Byte-level BPE of a tokenizers file; special tokens within texts are plain text.

    Merges are in the order of their ids, so tiktoken's much faster merging by ids gives the same tokens. Where a file has
    another order, and for texts with very long runs of white space, which tiktoken cannot cut, the tokenizers library encodes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = {token["id"] for token in held.get("added_tokens", ())}
        vocabulary, characters = held["model"]["vocab"], byte_characters()
        self.bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if i in special else bytes(characters[c] for c in token)
        merged = [vocabulary["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in held["model"]["merges"]]
        ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in special}
        ordered = all(a < b for a, b in zip(merged, merged[1:])) and len(ranks) == len(merged) + 256
        self.fast = tiktoken.Encoding("bytes", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def __call__(self, text: str):
        if self.fast is not None and not (len(text) > BLANK and _BLANK.search(text)):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceModel:
    """A sentencepiece model with byte fallback, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(self.processor.id_to_piece(i)) for i in range(self.processor.get_piece_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    def __call__(self, texts: list[str]):
        return self.processor.encode(texts, num_threads=1)


class _Bytes:
    """Bytes of all ids of a vocabulary, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Aligner:
    """Both vocabularies and the array from A ids to the B ids of the same bytes, -1 where there is none."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = ByteVocabulary(byte_vocabulary), PieceModel(piece_model)
        self.a_bytes, self.b_bytes = _Bytes(self.a.bytes), _Bytes(self.b.bytes)
        by_bytes = {entry: i for i, entry in enumerate(self.b.bytes)}  # of ids with the same bytes the last one, a piece rather than a byte
        self.same = np.array([by_bytes.get(entry, -1) if entry else -1 for entry in self.a.bytes], np.int64)
        most = max(len(self.a.bytes), len(self.b.bytes))
        decimal = [str(i).encode() for i in range(most)]
        self.digits = np.array([len(x) for x in decimal], np.int64)
        width = int(self.digits.max()) + 1
        self.decimal = np.frombuffer(b"".join(x.ljust(width) for x in decimal), np.uint8).reshape(most, width)

    def __call__(self, texts: list[str]) -> "Aligned":
        return Aligned(self, texts)


@lru_cache(maxsize=1)
def _aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    return Aligner(byte_vocabulary, piece_model)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.empty(int(counts.sum()), np.int64)
    at = 0
    for ids, n in zip(lists, counts.tolist(), strict=True):
        out[at : at + n] = ids
        at += n
    return out, counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` as long as ``counts`` say."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return before[ends] - before[ends - counts]


class Aligned:
    """Tokens, groups and links of some texts, as arrays over all of them; ``n_*`` and ``texts`` are by text."""

    def __init__(self, own: Aligner, texts: list[str]):
        self.own, n = own, len(texts)
        a, self.n_a = _flat([own.a(" " + text) if text else () for text in texts])
        b, self.n_b = _flat(own.b(texts))
        given = [(" " + text).encode() if text else b"" for text in texts]
        sizes = np.fromiter(map(len, given), np.int64, n)
        good = (sizes > 0) & (_sums(own.a_bytes.lengths[a], self.n_a) == sizes) & (_sums(own.b_bytes.lengths[b], self.n_b) == sizes)
        a, b = a[np.repeat(good, self.n_a)], b[np.repeat(good, self.n_b)]
        want = np.frombuffer(b"".join(x for x, ok in zip(given, good, strict=True) if ok), np.uint8)
        wrong = (own.a_bytes.joined(a) != want) | (own.b_bytes.joined(b) != want)
        if wrong.any():
            same = good.copy()
            same[good] = _sums(wrong, sizes[good]) == 0
            a, b = a[np.repeat(same[good], self.n_a[good])], b[np.repeat(same[good], self.n_b[good])]
            good = same
        self.n_a, self.n_b, sizes = np.where(good, self.n_a, 0), np.where(good, self.n_b, 0), np.where(good, sizes, 0)
        self.a, self.b, self.good, ends = a, b, good, np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(own.a_bytes.lengths[a]), np.cumsum(own.b_bytes.lengths[b])
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs are merged
        again = np.zeros(len(both), bool)
        again[1:] = both[1:] == both[:-1]
        common, cuts = both[again], both[~again]
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(common)), np.bincount(self.group_b, minlength=len(common))
        self.n_groups = np.diff(np.searchsorted(common, ends, "right"), prepend=0)
        # Between neighbouring ends of either kind lies the overlap of one token of A and one of B: one link.
        self.link_a, self.link_b = a[np.searchsorted(ends_a, cuts)], b[np.searchsorted(ends_b, cuts)]
        single = (self.in_a == 1) & (self.in_b == 1)
        self.foretold = single[np.searchsorted(common, cuts)] & (own.same[self.link_a] == self.link_b)
        self.n_links = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)

    def groups(self) -> list[bytes]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``."""
        own, n_a, n_b = self.own, len(self.a), len(self.b)
        upto_a, upto_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        place_a = np.arange(n_a) + (upto_b - self.in_b)[self.group_a]
        place_b = np.arange(n_b) + upto_a[self.group_b]
        ids, marks = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a[upto_a - 1]], marks[place_b[upto_b - 1]] = ord("|"), ord(";")
        written, digits = own.decimal[ids], own.digits[ids]
        written[np.arange(len(ids)), digits] = marks
        flat = written[np.arange(written.shape[1]) <= digits[:, None]].tobytes()
        ends = np.cumsum(_sums(digits + 1, self.n_a + self.n_b)).tolist()
        return [flat[start : max(start, end - 1)] for start, end in zip([0, *ends], ends, strict=False)]


# ---- Chunks ----------------------------------------------------------------------------------------------------------

_DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")


class _Chunk:
    """Documents whose pairs are counted together."""

    def __init__(self):
        self.size, self.documents, self.foretold, self.pairs = 0, [], [], []

    def add(self, doc_ids: pa.Array, aligned: Aligned, size: int) -> None:
        self.size += size
        digests = [hashlib.sha256(x).hexdigest() if ok else "" for x, ok in zip(aligned.groups(), aligned.good.tolist(), strict=True)]
        plain = aligned.foretold.astype(np.int64)
        self.documents.append((doc_ids, digests, [getattr(aligned, name) for name in _DOCUMENT], _sums(plain, aligned.n_links), _sums(1 - plain, aligned.n_links)))
        self.foretold.append(aligned.link_a[aligned.foretold].astype(np.int32))
        self.pairs.append((aligned.link_a[~aligned.foretold] << SHIFT) | aligned.link_b[~aligned.foretold])

    def write(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Write the documents with their links; give the distinct pairs and how often each occurs."""
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        columns = [pa.concat_arrays([d[0] for d in self.documents]), pa.array([x for d in self.documents for x in d[1]], pa.string())]
        columns += [pa.array(np.concatenate([d[2][k] for d in self.documents])) for k in range(len(_DOCUMENT))]
        for at, values in ((3, np.concatenate(self.foretold)), (4, places.astype(np.int32))):
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([d[at] for d in self.documents]))])
            columns.append(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, pa.int32())))
        batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "groups_sha256", *_DOCUMENT, "foretold", "pairs"])
        system, place = file_system(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        with system.open_output_stream(place, compression=None) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return pairs, np.bincount(places, minlength=len(pairs))


_COUNTED = "chunk bigint, file string, pair bigint, n bigint"


def _counted(chunk, file, pairs, counts) -> pa.RecordBatch:
    n = len(pairs)
    chunks = pa.nulls(n, pa.int64()) if chunk is None else pa.array(np.full(n, chunk, np.int64))
    files = pa.array([file] + [None] * (n - 1), pa.string()) if n else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([chunks, files, pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], ["chunk", "file", "pair", "n"])


def count(docs: DataFrame, byte_vocabulary: str, piece_model: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write the links of all documents; give how often each chunk holds each of its pairs, stored.

    A chunk's first row has the pair -1 and the chunk's file. Rows without a chunk are a task's vector, as pairs.
    """
    folder = new_folder(docs.sparkSession, "links")

    def chunks(batches):
        own, part, number = _aligner(byte_vocabulary, piece_model), TaskContext.get().partitionId(), 0
        vector, chunk = np.zeros(len(own.same), np.int64), _Chunk()

        def closed():
            file = f"{folder}/{part:08d}-{number:05d}-{uuid.uuid4().hex}.links"
            pairs, counts = chunk.write(file)
            return _counted(part << SHIFT | number, file, np.concatenate([[-1], pairs]), np.concatenate([[0], counts]))

        for batch in batches:
            texts, (_, offsets) = batch.column(1), utf8(batch.column(1))
            for i, j in slices(offsets):
                aligned = own([text or "" for text in texts.slice(i, j - i).to_pylist()])
                vector += np.bincount(aligned.link_a[aligned.foretold], minlength=len(vector))
                chunk.add(batch.column(0).slice(i, j - i), aligned, int(offsets[j] - offsets[i]))
                if chunk.size >= chunk_bytes:
                    yield closed()
                    number, chunk = number + 1, _Chunk()
        if chunk.documents:
            yield closed()
        met = np.flatnonzero(vector)
        yield _counted(None, None, (met << SHIFT) | own.same[met], vector[met])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(read.mapInArrow(tidy(chunks), _COUNTED), "counted")


def pair_counts(counted: DataFrame) -> DataFrame:
    """``pair, total, best`` of every pair of ids that is linked: its links in the corpus, and whether no pair of its B id has more."""
    totals = counted.where("pair >= 0").groupBy("pair").agg(F.sum("n").alias("total"))
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))  # no more rows than the vocabulary has ids
    joined = totals.withColumn("b", b).join(F.broadcast(most), "b")
    return joined.select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def linked_ids(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """``a_id, b_id, total, best`` over the whole corpus."""
    pairs = pair_counts(count(docs, byte_vocabulary, piece_model))
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return pairs.select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), b.cast("int").alias("b_id"), "total", "best")


def groups(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """``doc_id, groups`` of every document, the groups as ``a1,a2|b1;a3|b2,b3``; a text without tokens has none."""

    def listed(batches):
        own = _aligner(byte_vocabulary, piece_model)
        for batch in batches:
            texts, (_, offsets) = batch.column(1), utf8(batch.column(1))
            for i, j in slices(offsets):
                aligned = own([text or "" for text in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.decode() for x in aligned.groups()])], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(listed), "doc_id bigint, groups string")


_DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def digest(docs: DataFrame, byte_vocabulary: str, piece_model: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Counts and digest of the groups of every document, with the corpus-wide counts of its links."""
    with scratch(docs.sparkSession):
        counted = count(docs, byte_vocabulary, piece_model, chunk_bytes)
        totals = stored(pair_counts(counted), "pairs")
        # One row for each id of A at most.
        vector = totals.join(counted.where("chunk is null").select("pair").distinct(), "pair", "left_semi").toArrow()
        ids = vector.column("pair").to_numpy() >> SHIFT
        most = int(ids.max()) + 1 if len(ids) else 0
        foretold, best = np.zeros(most, np.int64), np.zeros(most, np.int64)
        foretold[ids], best[ids] = vector.column("total").to_numpy(), vector.column("best").to_numpy().astype(np.int64)
        chunks = counted.where("chunk is not null")
        met = chunks.join(totals, "pair", "left").select("chunk", "file", "pair", "total", "best")
        number = counted.where("pair = -1").count()
        # A given number of partitions, or the adaptive planner would let a few tasks read all files.
        dealt = met.repartition(min(MOST_TASKS, max(1, number)), "chunk").sortWithinPartitions("chunk", "pair")

        def told(batches):
            file, totals_, bests = None, [], []

            def read():
                total, top = np.concatenate([*totals_, [0]]), np.concatenate([*bests, [0]])
                system, place = file_system(file)
                with system.open_input_file(place) as held:
                    batch = pa.ipc.open_stream(held).read_next_batch()
                sums = []
                for name, by, top_by in (("foretold", foretold, best), ("pairs", total, top)):
                    lists = batch.column(name)
                    links, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                    sums.append((_sums(top_by[links], sizes), _sums(by[links], sizes)))
                columns = [batch.column("doc_id"), *[batch.column(name) for name in _DOCUMENT]]
                columns += [pa.array(sums[0][k] + sums[1][k]) for k in range(2)]
                return pa.RecordBatch.from_arrays([*columns, batch.column("groups_sha256")], [field.split()[0] for field in _DIGEST.split(", ")])

            for batch in batches:
                pairs = batch.column("pair").to_numpy()
                heads = np.flatnonzero(pairs < 0)
                total = batch.column("total").fill_null(0).to_numpy()
                top = batch.column("best").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
                for i, j in zip([0, *(heads + 1).tolist()], [*heads.tolist(), len(pairs)], strict=True):
                    totals_.append(total[i:j])
                    bests.append(top[i:j])
                    if j < len(pairs):
                        if file is not None:
                            yield read()
                        file, totals_, bests = batch.column("file")[j].as_py(), [], []
            if file is not None:
                yield read()

        return stored(dealt.mapInArrow(tidy(told), _DIGEST), "aligned", keep=True)
