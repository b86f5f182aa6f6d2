"""WARC bundles and token files: exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from workpulse.llm import tokenids, warc

PAGES = "page_id bigint, url string, html string, size int, digest int"
VOCABULARY = public_tokenizers.path(tokenids.VOCABULARY)


def _pages(spark, rows):
    return spark.createDataFrame([(*row, 1, 2) for row in rows], PAGES).repartition(3)


def _expected(rows):
    groups = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page_id is not None:
            digest = hashlib.sha1(payload).hexdigest()
            groups[digest] = max(groups.get(digest, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        digest = hashlib.sha1(payload).hexdigest()
        kept = groups.get(digest) if len(payload) >= 1000 else None
        refers = kept if kept is not None and (page_id is None or page_id < kept) else None
        out.append((str(page_id), len(payload), digest, "response" if refers is None else "revisit", str(refers)))
    return sorted(out)


def _got(frame):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in frame.collect())


ODD_PAGES = [
    (1, "http://a/é b\r\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "", None), (6, "u", ""),
    (7, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 60), (8, "u", "é" * 500), (9, "u", "é" * 500), (9, "u", "é" * 500),
    (None, "u", "y" * 2000), (None, "u", "y" * 2000), (None, "u", "x" * 1000), (10, "u", "long " * 600_000), (11, "u", "long " * 600_000),
]


def test_warc_round_trip(spark):
    assert _got(warc.digest(_pages(spark, ODD_PAGES))) == _expected(ODD_PAGES)


def test_warc_of_nothing(spark):
    assert warc.digest(_pages(spark, [])).collect() == []


def test_warc_hot_payload_and_small_frames(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 3000)
    monkeypatch.setattr(warc, "BUNDLE", 20_000)
    rows = [(i, f"u{i}", "hot" * 400 if i % 3 else f"own {i} " * 200) for i in range(200)]
    assert _got(warc.digest(_pages(spark, rows))) == _expected(rows)


def test_one_record_is_one_seek(spark):
    rows = [(i, f"http://u/{i}", f"<p>{i}</p>" * 300) for i in range(50)]
    index = warc.write(_pages(spark, rows))
    got = warc.fetched(index, spark.createDataFrame([(7,), (7,), (31,), (99,)], "page_id bigint")).collect()
    assert sorted(r.page_id for r in got) == [7, 31]
    for r in got:
        assert bytes(r.record).startswith(b"WARC/1.1\r\nWARC-Type: response") and f"<p>{r.page_id}</p>".encode() * 300 in bytes(r.record)


def test_bundles_are_plain_zstandard_with_a_seek_table(spark):
    index = warc.write(_pages(spark, [(i, "u", f"{i} " * 900) for i in range(30)]))
    path = index.first().bundle.removeprefix("file://")
    with open(path, "rb") as file:
        data = file.read()
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.filter(index.bundle == index.first().bundle).count()


@pytest.mark.parametrize("size", [0, 1, 5, 511, 512, 513, 3000])
@pytest.mark.parametrize("high", [2, 60, 50_000, 1 << 40, 1 << 63])
def test_simple8b_round_trip(size, high):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, high, size, dtype=np.uint64)
    if high == 1 << 63:
        ids[::3] = 3
        ids[1::7] = (1 << 64) - 1
        ids[2::7] = 5  # looks like an escape when it stands as it is
    coded, offsets = tokenids.encode(ids)
    assert (tokenids.decode(coded) == ids).all()
    for k in range(len(offsets) - 1):
        block = ids[k * tokenids.BLOCK : (k + 1) * tokenids.BLOCK]
        assert (tokenids.decode(coded[offsets[k] : offsets[k + 1]]) == block).all()


ODD_TEXTS = [
    "Ab's don't 're!! x'll", "é é É", "<|endoftext|> a<|startoftext|>B", "<|STARTOFTEXT|>", "a b c \x1c d\x85e", "ΑΣ ΟΔΟΣ. Σ", "İSTANBUL, ",
    "123abc,45!?'s,", "日本語。テスト", "!'s!'t", "a,,'re", "x.'S y.'s", "", "  ", "T̈ẗ Ä≠ ≠", "%%% ### a%%%", "word " * 5000, None,
]


def _expected_ids(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_agree_with_the_tokenizer(docs):
    rows = [(3 * i, text) for i, text in enumerate(ODD_TEXTS)] + [(None, "no id")]
    got = [tuple(r)[:4] for r in tokenids.digest(docs(rows, clash=True), VOCABULARY).orderBy("start").collect()]
    assert got == _expected_ids(rows)


def test_token_files_of_repeated_rows_and_of_nothing(docs):
    rows = [(1, "same text"), (1, "same text"), (2, "other")]
    got = [tuple(r) for r in tokenids.digest(docs(rows), VOCABULARY).orderBy("start").collect()]
    assert got == _expected_ids(rows)
    assert tokenids.digest(docs([]), VOCABULARY).collect() == []


def test_token_files_roll_over(docs, monkeypatch):
    monkeypatch.setattr(tokenids, "FILE_IDS", 200)
    monkeypatch.setattr(tokenids, "SLICE", 300)
    rows = [(i, f"the number {i} and more " * 9) for i in range(60)]
    assert [tuple(r) for r in tokenids.digest(docs(rows), VOCABULARY).orderBy("start").collect()] == _expected_ids(rows)


def test_piece_memory_is_bounded():
    pieces = tokenids.Pieces(VOCABULARY, most=10)
    data = np.frombuffer(b"one two three four five six seven eight nine ten eleven twelve", np.uint8)
    first = pieces(data, np.array([0, len(data)]), 2)
    again = pieces(data, np.array([0, len(data)]), 2)
    assert (first[1] == again[1]).all() and len(pieces.known) <= 12
