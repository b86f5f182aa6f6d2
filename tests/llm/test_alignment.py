"""Links of two tokenizers against plain loops over the tokens of each text."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from workpulse.llm import alignment

A = public_tokenizers.path(alignment.BYTE_VOCABULARY)
B = public_tokenizers.path(alignment.PIECE_MODEL)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _tokens(text, a, b):
    """(id, start, end) of both tokenizers' tokens, or None."""
    if not text:
        return None
    characters = alignment.byte_characters()
    out = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    pieces = [(i, bytes(characters[c] for c in a.id_to_token(i))) for i in ids], []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
        pieces[1].append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
    for own in pieces:
        if b"".join(x for _, x in own) != (" " + text).encode():
            return None
        at, placed = 0, []
        for i, x in own:
            placed.append((i, at, at + len(x)))
            at += len(x)
        out.append(placed)
    return out


def _expected(rows, tokenizers):
    told, counts = [], collections.Counter()
    for doc_id, text in rows:
        tokens = _tokens(text, *tokenizers)
        links, groups = [], []
        if tokens:
            own, other = tokens
            first = 0
            for i, start, end in own:
                while other[first][2] <= start:
                    first += 1
                k = first
                while k < len(other) and other[k][1] < end:
                    links.append((i, other[k][0]))
                    k += 1
            shared = sorted({e for _, _, e in own} & {e for _, _, e in other})
            begin = 0
            ia = ib = 0
            for end in shared:
                ja, jb = ia, ib
                while ja < len(own) and own[ja][2] <= end:
                    ja += 1
                while jb < len(other) and other[jb][2] <= end:
                    jb += 1
                groups.append(",".join(str(x[0]) for x in own[ia:ja]) + "|" + ",".join(str(x[0]) for x in other[ib:jb]))
                ia, ib, begin = ja, jb, end
        counts.update(links)
        told.append((doc_id, tokens, links, groups))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, tokens, links, groups in told:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if tokens else ""
        n_a, n_b = (len(tokens[0]), len(tokens[1])) if tokens else (0, 0)
        out.append((str(doc_id), n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out)


def _got(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   \n\t "), (5, "Hello world"), (6, "Hello world"), (6, "Hello world"), (None, "Hello world"), (None, None),
    (7, "<|endoftext|> and <s> and </s> <unk> <0x41>"), (8, "▁ is a space there"), (9, "aaaa aaaaaaaaaaa aaaaaaaa" * 30), (10, "naïve ﬁ Å Å 中文字 😀😀 \x00\x01"),
    (11, "x" * 5000), (12, "é" * 5000), (13, " " * 3000 + "end"), (14, "word " * 150_000), (15, "I'll we've don't 12345 1,000.50\r\n\r\n"), (16, "� \u0085 　  "),
]


@pytest.mark.parametrize("clash", [False, True])
def test_odd_texts(docs, tokenizers, clash):
    assert _got(alignment.digest(docs(ODD, clash), A, B)) == _expected(ODD, tokenizers)


def test_many_chunks_and_hot_pairs(docs, tokenizers):
    """Chunks of 2 KB; a third of the rows have one text; one pair is foretold here and part of a larger group there."""
    rng = random.Random(3)
    syllables = ["an", "the", "eau", "stö", "a", "aa", " ", " ", ", ", ".\n", "'s", "çé", "1", "22"]
    rows = [(i, "the same text of every row" if i % 3 == 0 else "".join(rng.choices(syllables, k=rng.randint(1, 400)))) for i in range(300)]
    assert _got(alignment.digest(docs(rows), A, B, chunk_bytes=2000)) == _expected(rows, tokenizers)


def test_the_test_table(spark, sf_dir, tokenizers):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert _got(alignment.digest(frame, A, B)) == _expected(rows, tokenizers)


def test_no_rows(docs):
    assert alignment.digest(docs([]), A, B).collect() == []
    assert alignment.linked_ids(docs([]), A, B).collect() == []


def test_groups_and_pairs(docs, tokenizers):
    rows = [(1, "Hello there, naïve world"), (2, None), (3, "Hello")]
    got = {r.doc_id: r.groups for r in alignment.groups(docs(rows), A, B).collect()}
    told = {int(row[0]): row for row in _expected(rows, tokenizers)}
    assert got[2] == "" and all(hashlib.sha256(got[i].encode()).hexdigest() == told[i][-1] for i in (1, 3))
    pairs = alignment.linked_ids(docs(rows), A, B).collect()
    assert sum(r.total for r in pairs) == sum(row[4] for row in told.values())
    best = {}
    for r in pairs:
        best[r.b_id] = max(best.get(r.b_id, 0), r.total)
    assert all(r.best == (r.total == best[r.b_id]) for r in pairs)


def test_both_byte_level_encoders_agree(tokenizers):
    """The faster one cuts at the same characters: all letters, digits, spaces and marks of the planes in use."""
    own = alignment.ByteVocabulary(A)
    assert own.fast is not None
    for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1F000, 0x1F100)]:
        text = f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2  {chr(c)}."
        assert own(text) == tokenizers[0].encode(text, add_special_tokens=False).ids, hex(c)


def test_a_vocabulary_whose_merges_have_another_order(tmp_path, tokenizers):
    import json

    held = json.load(open(A, encoding="utf-8"))
    held["model"]["merges"][10], held["model"]["merges"][11] = held["model"]["merges"][11], held["model"]["merges"][10]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(held))
    own = alignment.ByteVocabulary(str(path))
    assert own.fast is None and own(" Hello") == tokenizers[0].encode(" Hello", add_special_tokens=False).ids


@pytest.mark.parametrize("filler", [" ", "\n", "\u3000", "a", "é", "1", "!"])
def test_texts_of_one_character(docs, tokenizers, filler):
    """Runs of a million: among them white space that the faster encoder cannot cut."""
    own = alignment.ByteVocabulary(A)
    text = f"x{filler * 1_000_000}y z"
    assert list(own(text)) == tokenizers[0].encode(text, add_special_tokens=False).ids


def test_a_long_blank_text(docs, tokenizers):
    rows = [(1, " " * 1_200_000 + "end"), (2, "short"), (3, "\n" * 1_000_000)]
    assert _got(alignment.digest(docs(rows), A, B)) == _expected(rows, tokenizers)
