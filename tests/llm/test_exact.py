"""Exact duplicates by block naming, against a dictionary of normalised texts."""

import hashlib
import re
from collections import defaultdict

import pytest

from workpulse.llm import naming


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for plain, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(str(None if missing else i), str(keep), len(members), at == 0, digest) for at, (_, missing, i) in enumerate(members)]
    return sorted(out)


def _got(frame):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in frame.collect())


LONG = "".join(f"word {i} \n" for i in range(4000))
ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (None, " "), (None, None), (4, "a b"), (5, "ab"), (6, "a b"), (7, "ab\x00"), (8, "a  b"), (9, "a b "),
    (10, LONG), (11, LONG.replace(" ", "")), (12, LONG[:-3]), (13, LONG + "x"), (14, "y" + LONG), (15, LONG), (15, LONG), (16, "é" * 9000), (17, "é" * 8999 + "è"), (18, "ü" * 9000),
    (19, "x" * 64), (20, "x" * 128), (21, "x" * 63 + " x"), (22, "x" * 8192), (23, "x" * 16384), (24, "x" * 16385), (None, LONG), (25, "z"), (25, "zz"), (25, "z z"),
]


@pytest.mark.parametrize("size", [64, naming.BLOCK])
@pytest.mark.parametrize("clash", [False, True])
def test_groups_are_those_of_equal_texts(docs, size, clash):
    assert _got(naming.exact_duplicates(docs(ODD, clash), size)) == _expected(ODD)


def test_blocks_that_share_a_hash_and_lie_in_many_tasks(docs, monkeypatch):
    """All blocks have one hash, so the bytes alone part them; one text makes up most of the rows."""
    monkeypatch.setattr(naming.F, "xxhash64", lambda *_: naming.F.lit(7).cast("bigint"))
    rows = [(i, "the same text" if i % 3 else f"own {i % 11} text " * 5) for i in range(600)]
    assert _got(naming.exact_duplicates(docs(rows), 16)) == _expected(rows)


def test_hot_blocks_in_different_documents(docs):
    page = "boilerplate " * 20
    rows = [(i, page * (1 + i % 4) + str(i % 50) + page) for i in range(400)]
    assert _got(naming.exact_duplicates(docs(rows), 32)) == _expected(rows)


def test_the_pairs_of_a_long_text(docs):
    """Names of pairs follow the places: the same blocks in another order are another text."""
    blocks = ["a" * 8, "b" * 8, "c" * 8]
    rows = [(i, "".join(blocks[(i // 3**k) % 3] for k in range(5))) for i in range(243)] * 2
    assert _got(naming.exact_duplicates(docs(rows), 8)) == _expected(rows)


def test_no_rows(docs):
    assert naming.exact_duplicates(docs([])).collect() == []


def test_rows_that_stay(docs):
    rows = [(1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (4, None), (5, " "), (None, "d"), (6, "e")]
    left = naming.without_duplicates(docs(rows, clash=True))
    assert left.columns[:2] == ["doc_id", "text"] and "rank" in left.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(map(str, [(1, "a b"), (3, "c"), (5, " "), (None, "d"), (6, "e")]))
