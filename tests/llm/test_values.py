"""Regular words and strings whose values must differ: polynomials modulo a power of two are equal for them, whatever the base."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from workpulse.llm import neardup, repeats, tokenids
from workpulse.llm.text import parts, word_values, words

VOCABULARY = public_tokenizers.path(tokenids.VOCABULARY)


def thue_morse(size, letters="ab"):
    word = letters[0]
    while len(word) < size:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word[:size]


def _values(texts):
    out = []
    for _, _, data, offsets in parts(pa.array(texts)):
        starts, ends, _ = words(data, offsets)
        out += word_values(data, starts, ends).tolist()
    return out


@pytest.mark.parametrize("size", [16, 17, 32, 64, 512, 1024, 2048, 4096])
def test_words_and_their_complements(size):
    pair = [thue_morse(size, "ab"), thue_morse(size, "ba")]
    first, second = _values(pair)
    assert first != second
    # Equal words have equal values wherever they stand.
    assert _values([f"x {pair[0]} y {pair[0]}", pair[0]])[1::2] == [first, first]


def test_words_around_the_size_of_a_piece():
    texts = ["a" * n for n in range(1, 70)] + ["b" + "a" * n for n in range(1, 70)] + ["a" * n + "b" for n in range(1, 70)]
    assert len(set(_values(texts))) == len(set(texts))


@pytest.mark.parametrize("size", [512, 1024, 2048])
def test_regular_words_are_no_near_duplicates(docs, size):
    a, b = thue_morse(size, "ab"), thue_morse(size, "ba")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs([(1, a), (2, b), (3, a), (4, f"{a} {b}"), (5, f"{b} {a}")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def _ids(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [zlib.crc32(np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()) for text in texts]


def test_ids_of_regular_words(docs):
    texts = [f"{thue_morse(size, letters)} end" for size in (512, 1024, 2048) for letters in ("ab", "ba")]
    got = tokenids.digest(docs(list(enumerate(texts))), VOCABULARY).orderBy("start").collect()
    assert [r.ids_crc32 for r in got] == _ids(texts)


def test_ids_when_all_values_are_equal(monkeypatch):
    """Pieces are told by their bytes, in a slice and among those that are known."""
    monkeypatch.setattr(tokenids, "word_values", lambda data, starts, ends, fold: np.full(len(starts), 5, np.uint64))
    pieces = tokenids.Pieces(VOCABULARY)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for texts in (["one"], ["two one", "", "four"], ["six"], ["one", "one"]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        counts, ids = pieces(data, offsets, 2)
        want = [[*tokenizer.encode(text, add_special_tokens=False).ids, 2] for text in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def _removed(rows):
    return {r.doc_id: r.n_removed for r in rows.collect()}


def test_regular_strings_do_not_repeat(docs):
    rows = [(i, thue_morse(size, letters)) for i, (size, letters) in enumerate((size, letters) for size in (512, 1024, 2048) for letters in ("cd", "dc"))]
    texts = dict(rows)

    def brute(doc):
        seen = {}
        for i, text in texts.items():
            for at in range(len(text) - 399):
                seen.setdefault(text[at : at + 400], set()).add((i, at))
        gone = set()
        for at in range(len(texts[doc]) - 399):
            if len(seen[texts[doc][at : at + 400]]) > 1:
                gone.update(range(at, at + 400))
        return len(gone)

    assert _removed(repeats.digest(docs(rows))) == {i: brute(i) for i in texts}


def test_regular_pieces_that_cancel_each_other(docs):
    """T, M, U and U, M, T share no string of 400 bytes, though the differences of their halves cancel modulo 2**64."""
    for letters in ("ab", "cd", "ef", "mn"):
        t, u = thue_morse(256, letters), thue_morse(256, letters[::-1])
        for seed in range(25):
            middle = "".join(random.Random(seed).choices("abcdefghij", k=96))
            keys = []
            for text in (t + middle + u, u + middle + t):
                data = np.frombuffer(text.encode(), np.uint8)
                values, ends, lows, highs, kinds = repeats.triggers(data, np.array([0, len(data)]))
                own = kinds == 2
                core = values.of(np.where(own, lows, ends - repeats.WINDOW), np.where(own, lows + repeats.LENGTH, ends + repeats._AFTER), kinds, repeats.CORE)
                context = values.of(lows, highs + repeats.LENGTH, ((ends - lows) << 10) + (ends - highs), repeats.CONTEXT)
                keys.append((set(core.tolist()), set(context.tolist())))
            assert not keys[0][1] & keys[1][1]
    assert _removed(repeats.digest(docs([(1, t + middle + u), (2, u + middle + t)]))) == {1: 0, 2: 0}


def test_polynomials_are_those_of_plain_integers():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, repeats._P, 200, dtype=np.uint64), rng.integers(0, repeats._P, 200, dtype=np.uint64)
    x[:3], y[:3] = repeats._P - 1, repeats._P - 1
    assert repeats.product(x, y).tolist() == [a * b % repeats._P for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    values = repeats.Values(data)
    for lane, own in enumerate(repeats._LANES):
        begin, end = np.array([0, 5, 2000, 17]), np.array([3000, 405, 2400, 17])
        want = [sum(int(own.codes[data[b + k]]) * pow(own.bases["up"], k, repeats._P) for k in range(e - b)) % repeats._P for b, e in zip(begin, end, strict=True)]
        assert values.raw(begin, end, lane).tolist() == want


def test_rows_without_an_id_and_repeated_rows(docs):
    """Many rows share the null id, and some their text too; each is judged by itself."""
    shared = "".join(chr(97 + (i * 7 + i * i) % 26) for i in range(500))
    rows = [(None, f"{i} own words {i * 37} and {shared if i % 5 == 0 else i}") for i in range(60)] + [(7, f"copy {shared}")] * 4
    starts = {}
    for n, (_, text) in enumerate(rows):
        for at in range(len(text) - 399):
            starts.setdefault(text[at : at + 400], []).append((n, at))
    gone = [set() for _ in rows]
    for places in starts.values():
        for n, at in places if len(places) > 1 else ():
            gone[n].update(range(at, at + 400))
    want = sorted((str(i), len(text), len(own)) for (i, text), own in zip(rows, gone, strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats.digest(docs(rows)).collect()) == want
