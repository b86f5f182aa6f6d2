"""Token ids in Simple-8b files: 64-bit words that each hold as many ids as fit, with a footer for random reading.

A file holds the ids of whole documents in ascending order of id. Ids are cut into blocks of `BLOCK`. A block is a run of
64-bit little-endian words; the four high bits of a word are its selector, which says how many ids of how many bits
follow, the first id lowest. Selector 0 is an escape: the next word is one id as it is, for ids over 60 bits.
The footer is an Arrow table of documents (row number, id, count), the offset of each block in words, then the lengths and a
closing mark. A block can be decoded without its neighbours, and all words of one selector are decoded in one numpy step.

Documents are sorted by (doc_id, hash of the text) over the whole table; null ids come first, null texts are empty and give only
the end id. Repeated rows are encoded again. An empty table gives no file. Further columns are not read.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from workpulse.llm.storage import file_system, new_folder, stored
from workpulse.llm.text import parts, tidy, word_values, words

MARK = b"WPS8B001"
BLOCK = 512
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)  # ids in a word, by selector
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
END_ID = 2
FILE_IDS = 1 << 24  # a task starts another file after so many ids
MOST_TASKS = 10_000  # that read files back; beyond, a task reads several
SLICE = 1 << 19
_TAIL = np.array([32 < c < 127 and not chr(c).isalnum() and chr(c) != "'" for c in range(256)])
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
VOCABULARY = "word_bpe_49k.json"


# ---- Simple-8b -------------------------------------------------------------------------------------------------------


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    width = np.ones(len(ids), np.uint8)
    rest = ids >> np.uint64(1)
    while rest.any():
        width += rest > 0
        rest = rest >> np.uint64(1)
    return width


_SMALL = _widths(np.arange(1 << 16, dtype=np.uint64))


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of ``ids``, and the offset of each block in words (with the total at the end)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = _SMALL[ids] if ids.max() < 1 << 16 else _widths(ids)
    most = int(COUNTS.max())
    left = np.minimum(BLOCK - np.arange(min(BLOCK, n)), most).astype(np.uint8)  # ids up to the end of the block, or many
    left = np.resize(left, n)
    left[-most:] = np.minimum(left[-most:], np.arange(n, 0, -1)[-most:])
    selector = np.zeros(n, np.uint8)
    widest, span = width, 1  # widest id of the next ``span`` ids
    for s in range(len(COUNTS) - 1, 0, -1):
        while span < COUNTS[s]:
            step = min(span, int(COUNTS[s]) - span)
            grown = widest.copy()
            inner = max(0, n - step)
            np.maximum(widest[:inner], widest[n - inner :], out=grown[:inner])
            widest, span = grown, span + step
        fits = (widest <= BITS[s]) & (left >= COUNTS[s])
        selector = np.where(fits, np.uint8(s), selector)
    taken = np.maximum(COUNTS[selector], 1)
    # All blocks take their next word at the same time.
    at, chosen = np.arange(0, n, BLOCK), []
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        chosen.append(at)
        at = at + taken[at]
        open_ = at < ends
        at, ends = at[open_], ends[open_]
    places = np.sort(np.concatenate(chosen))
    kinds = selector[places]
    first = np.concatenate([[0], np.cumsum(np.where(kinds == 0, 2, 1))])
    out = np.zeros(first[-1], np.uint64)
    for s in np.unique(kinds):
        rows = np.flatnonzero(kinds == s)
        if s == 0:
            out[first[rows] + 1] = ids[places[rows]]
            continue
        word = np.full(len(rows), np.uint64(int(s) << 60))
        for k in range(int(COUNTS[s])):
            word |= ids[places[rows] + k] << np.uint64(k * int(BITS[s]))
        out[first[rows]] = word
    starts = np.searchsorted(places, np.arange(0, n, BLOCK))
    return out, np.append(first[starts], first[-1])


def decode(coded: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    kinds = (coded >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(coded), bool)
    for place in np.flatnonzero(kinds == 0).tolist():
        if not raw[place]:  # else it is an id as it is that looks like an escape
            raw[place + 1] = True
    counts = np.where(raw, 1, COUNTS[np.where(raw, 0, kinds)])
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(first[-1], np.uint64)
    out[first[:-1][raw]] = coded[raw]
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero((kinds == s) & ~raw)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s]) if len(rows) else 0):
            out[first[rows] + k] = (coded[rows] >> np.uint64(k * int(BITS[s]))) & mask
    return out


# ---- Files -----------------------------------------------------------------------------------------------------------


class Writer:
    """One file of documents. Blocks are coded as they fill up, so only one block run is held."""

    def __init__(self, path: str):
        system, place = file_system(path)
        system.create_dir(os.path.dirname(place), recursive=True)
        self.out = system.open_output_stream(place, compression=None)
        self.out.write(MARK)
        self.offsets, self.words, self.ids, self.rows = [np.zeros(1, np.int64)], 0, 0, []
        self.held = np.zeros(0, np.uint64)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.rows.append(pa.record_batch([doc_ids, pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]))
        self.ids += len(ids)
        self.held = np.concatenate([self.held, ids.astype(np.uint64)])
        whole = len(self.held) // BLOCK * BLOCK
        self._put(self.held[:whole])
        self.held = self.held[whole:]

    def _put(self, ids: np.ndarray) -> None:
        coded, offsets = encode(ids)
        self.out.write(coded.astype("<u8").tobytes())
        self.offsets.append(offsets[1:] + self.words)
        self.words += len(coded)

    def close(self) -> None:
        self._put(self.held)
        table = io.BytesIO()
        with pa.ipc.new_stream(table, self.rows[0].schema) as stream:
            for batch in self.rows:
                stream.write_batch(batch)
        table, offsets = table.getvalue(), np.concatenate(self.offsets).astype("<i8").tobytes()
        self.out.write(offsets + table + struct.pack("<QQQ", len(offsets), len(table), self.ids) + MARK)
        self.out.close()


class Reader:
    """Documents of one file; any run of blocks can be read alone."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        head = self.file.read_at(24 + len(MARK), size - 24 - len(MARK))
        if head[24:] != MARK:
            raise ValueError(f"{path} is cut off")
        n_offsets, n_table, self.ids = struct.unpack("<QQQ", head[:24])
        body = self.file.read_at(n_offsets + n_table, size - 24 - len(MARK) - n_offsets - n_table)
        self.offsets = np.frombuffer(body[:n_offsets], "<i8")
        self.docs = pa.ipc.open_stream(body[n_offsets:]).read_all()

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` to ``last``, the last one not included."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return decode(np.frombuffer(self.file.read_at((b - a) * 8, len(MARK) + a * 8), "<u8"))

    def documents(self, many: int = 256):
        """``doc_ids, counts, ids`` of runs of documents, reading ``many`` blocks at a time."""
        counts = self.docs.column("n_tokens").to_numpy()
        ends, blocks, row, read, held = np.cumsum(counts), len(self.offsets) - 1, 0, 0, np.zeros(0, np.uint64)
        start = 0
        for first in range(0, blocks, many):
            got = self.blocks(first, min(blocks, first + many))
            read += len(got)
            held = np.concatenate([held, got])
            upto = int(np.searchsorted(ends, read, "right"))
            if upto > row:
                used = int(ends[upto - 1]) - start
                yield self.docs.column("doc_id")[row:upto], counts[row:upto], held[:used]
                held, start, row = held[used:], int(ends[upto - 1]), upto


# ---- Tokens ----------------------------------------------------------------------------------------------------------


_PARTS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # masks of the first bytes of eight


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, for all places but the last seven."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


class Pieces:
    """Ids of texts, by pieces that are encoded once and kept.

    The vocabulary's tokenizer drops white space, and no match or composition of characters reaches over it, so the ids
    of a text are those of its words in order. For the same reason a word that ends in an ASCII letter and then ASCII
    punctuation other than an apostrophe is taken apart between the two. A-Z are lowered before, as the tokenizer would do
    after composing characters, unless a byte that may compose follows. Texts with the opening of a special token are
    left as they are. Pieces are found by a 64-bit value of their bytes and then compared byte by byte, in the slice and with what is known; a
    slice in which two pieces share a value is encoded without this memory. At most ``most`` pieces are kept.
    """

    def __init__(self, vocabulary: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(vocabulary), most
        self._clear()

    def _clear(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0  # of all known pieces
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, values: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces; ``values`` are sorted."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = int(sizes.sum())
        if self.held + whole + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[: self.held], np.zeros(max(len(self.bytes), 2 * whole) + 8, np.uint8)])
        self.bytes[self.held : self.held + whole] = np.frombuffer(b"".join(pieces), np.uint8)
        self.begins = np.concatenate([self.begins, self.held + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.held += whole
        pieces = [piece.decode() for piece in pieces]
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(lengths.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), 2 * total), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(coded), np.uint32, total)
        places = np.searchsorted(self.known, values)
        self.known = np.insert(self.known, places, values)
        self.slots = np.insert(self.slots, places, np.arange(len(values)) + len(self.starts))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += total

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of the texts that lie in ``data`` at ``offsets``, each closed by ``end_id``."""
        if len(self.known) > self.most:
            self._clear()
        plain = b"<|" not in data.tobytes()
        if plain and len(data):
            raised = (data >= 65) & (data <= 90)
            raised[:-1] &= data[1:] < 128
            data = data + raised.astype(np.uint8) * np.uint8(32)
        starts, ends, firsts = words(data, offsets)
        if plain and len(starts):
            solid = np.where(_TAIL[data], -1, np.arange(len(data)))
            core = np.maximum.accumulate(solid)[ends - 1] + 1
            cut = np.flatnonzero((core > starts) & (core < ends) & _LETTER[data[np.maximum(core, 1) - 1]])
            starts, ends = np.insert(starts, cut + 1, core[cut]), np.insert(ends, cut, core[cut])
            firsts = firsts + np.searchsorted(cut, firsts)
        values = word_values(data, starts, ends, fold=False)
        distinct, first, which = np.unique(values, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True))
        if len(fresh):
            view, at = data.tobytes(), first[fresh]
            self._learn(distinct[fresh], [view[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        slots = self.slots[np.searchsorted(self.known, distinct)][which]
        if not self._same(data, starts, ends, slots):
            return self._plain(data, offsets, end_id)
        lengths = self.lengths[slots]
        before = np.concatenate([[0], np.cumsum(lengths)])
        counts = before[firsts[1:]] - before[firsts[:-1]] + 1
        out = np.empty(int(before[-1]) + len(counts), np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        out[~inner] = end_id
        out[inner] = self.flat[np.repeat(self.starts[slots] - before[:-1], lengths) + np.arange(int(before[-1]))]
        return counts, out

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> bool:
        """Whether every piece has the bytes of the known piece in its slot, eight bytes at a time."""
        sizes, known = ends - starts, self.begins[slots]
        if (sizes != self.sizes[slots]).any():
            return False
        own, held = _eights(np.concatenate([data, np.zeros(8, np.uint8)])), _eights(self.bytes)
        while len(sizes):
            if ((own[starts] ^ held[known]) & _PARTS[np.minimum(sizes, 8)]).any():
                return False
            more = sizes > 8
            starts, known, sizes = starts[more] + 8, known[more] + 8, sizes[more] - 8
        return True

    def _plain(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of whole texts, each encoded by itself."""
        view = data.tobytes()
        texts = [view[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        coded = [[*x.ids, end_id] for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, coded), np.int64, len(coded)), np.fromiter(chain.from_iterable(coded), np.uint32)


@lru_cache(maxsize=1)
def _pieces(vocabulary: str) -> Pieces:
    return Pieces(vocabulary)


def write(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Write the ids of all documents; return the manifest of files (``part, number, file, ids``) and their folder.

    Each attempt of a task writes files of its own name; only those that the finished attempt reports are in the
    manifest, so a lost executor leaves at most files that nobody reads.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def files(batches):
        part, pieces = TaskContext.get().partitionId(), _pieces(vocabulary)
        writer, number, done = None, 0, []
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1), SLICE):
                if writer is None:
                    name = f"{folder}/{part:08d}-{number:05d}-{uuid.uuid4().hex}.s8b"
                    writer = Writer(name)
                counts, ids = pieces(data, offsets, end_id)
                writer.add(batch.column(0).slice(i, j - i), counts, ids)
                if writer.ids >= FILE_IDS:
                    writer.close()
                    done.append((part, number, name, writer.ids))
                    writer, number = None, number + 1
        if writer is not None:
            writer.close()
            done.append((part, number, name, writer.ids))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["part", "number", "file", "ids"])

    return stored(ordered.mapInArrow(tidy(files), "part bigint, number bigint, file string, ids bigint"), "manifest"), folder


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files. The window runs over one row a file."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def rows(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for doc_ids, counts, ids in Reader(file).documents():
                    small, ends = ids.astype("<u4"), np.cumsum(counts)
                    sums = [zlib.crc32(small[e - c : e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                    doc_ids = doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
                    yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    # A given number of partitions, or the adaptive planner would put the few bytes of the manifest, and so all files, into one task.
    files = placed.select("file", "start").repartition(min(MOST_TASKS, max(1, manifest.count())), "file")
    return files.mapInArrow(tidy(rows), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def digest(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the files, then read them back."""
    return read(write(docs, vocabulary, end_id)[0])
