"""Near-duplicates, repeated passages, leaks and licenses against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from workpulse.llm import components, decontamination, licenses, neardup, repeats
from workpulse.llm.text import parts, shingles, word_values, words

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"w{i}" for i in range(400)]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def _set(text, size=5):
    own = _words(text)
    return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1)) or frozenset([tuple(own)] if own else [])


def _prose(rng, count):
    return " ".join(rng.choices(VOCABULARY, k=count))


def test_words_and_shingles_agree_with_plain_python():
    texts = ["", "a", "A b\tC\x0bd", "one two three four five", "É é ß", "x  y\n\nz", None, " lead", "a b c d e f g"]
    shingle_of, back = {}, {}
    for k, _, data, offsets in parts(pa.array(texts), 12):
        starts, ends, firsts = words(data, offsets)
        values, first = shingles(word_values(data, starts, ends), firsts)
        for i in range(len(offsets) - 1):
            own = _words(texts[k + i])
            runs = [tuple(own[a : a + 5]) for a in range(len(own) - 4)] or ([tuple(own)] if own else [])
            got = values[first[i] : first[i + 1]].tolist()
            assert len(got) == len(runs)
            for run, value in zip(runs, got, strict=True):
                assert shingle_of.setdefault(run, value) == value and back.setdefault(value, run) == run


# ---- Near-duplicates -------------------------------------------------------------------------------------------------


def _components(rows):
    sets = [(doc_id, _set(text)) for doc_id, text in rows]
    ids = sorted({doc_id for doc_id, _ in sets if doc_id is not None})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k, (doc_id, own) in enumerate(sets):
        for other in {o for s in own for o in holders[s]}:
            theirs = sets[other][1]
            if doc_id is None or sets[other][0] is None:
                continue
            if 100 * len(own & theirs) >= 75 * len(own | theirs):
                a, b = root(doc_id), root(sets[other][0])
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(k)
    return sorted((str(d), len(s), str(d if d is None else root(d))) for d, s in sets)


def _check_components(frame, rows):
    got = frame.collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == _components(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(docs):
    rng = random.Random(1)
    base = _prose(rng, 60)
    rows = [(5, base), (3, base), (9, base.upper()), (7, base + " end"), (1, ""), (2, None), (4, " \n"), (6, "a b"), (8, "A  b"), (10, "b a")]
    rows += [(None, base), (None, base), (11, _prose(rng, 30_000)), (12, base), (12, base), (13, "one"), (14, "one two three four five")]
    _check_components(neardup.near_duplicates(docs(rows, clash=True)), rows)
    left = neardup.without_near_duplicates(docs(rows, clash=True))
    assert left.columns == docs(rows, clash=True).columns
    assert sorted((r.doc_id for r in left.collect() if r.doc_id is not None)) == [1, 2, 3, 4, 6, 10, 11, 13, 14]
    assert left.filter("doc_id is null").count() == 2


def test_near_duplicates_of_nothing(docs):
    assert neardup.near_duplicates(docs([])).collect() == []
    assert neardup.near_duplicates(docs([(1, None), (2, "")])).count() == 2


def _variants(rng, base, count, edits):
    out = []
    for _ in range(count):
        own = base.split()
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        out.append(" ".join(own))
    return out


def test_near_duplicates_groups_around_the_threshold(docs):
    rng = random.Random(2)
    texts = []
    for size, count, edits in ((80, 40, 4), (80, 60, 8), (200, 50, 9), (30, 30, 2), (8, 20, 1), (120, 150, 3)):
        texts += _variants(rng, _prose(rng, size), count, edits)
    texts += [_prose(rng, rng.randint(5, 200)) for _ in range(150)]
    passage = _prose(rng, 40)  # shared by many that are no near-duplicates
    texts += [f"{passage} {_prose(rng, 30)}" for _ in range(120)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    _check_components(neardup.near_duplicates(docs(rows)), rows)


def test_crowded_regions_go_deeper(docs, monkeypatch):
    """A family of texts that share much, but mostly too little, next to many that are linked."""
    deeper = []
    across = neardup._across
    monkeypatch.setattr(neardup, "_across", lambda *a: deeper.append(across(*a)) or deeper[-1])
    monkeypatch.setattr(neardup, "OUTSIDE", 8)
    rng = random.Random(3)
    base = _prose(rng, 100).split()
    texts = []
    for _ in range(120):
        own = base[:72] + _prose(rng, 28).split()
        texts.append(" ".join(own))
    texts += _variants(rng, " ".join(base), 60, 6)
    rows = list(enumerate(texts))
    _check_components(neardup.near_duplicates(docs(rows)), rows)
    assert deeper


@pytest.mark.parametrize("sent", [neardup.SENT, 0])
def test_links_within_a_family_of_templated_texts(docs, monkeypatch, sent):
    """600 texts that share 0.72 of their shingles, some with a partner at 0.75 to 0.80; with what is shared sent to the tasks, and joined."""
    monkeypatch.setattr(neardup, "SENT", sent)
    rng = random.Random(12)
    wide = [f"v{i}" for i in range(3000)]
    form = " ".join(rng.choices(wide, k=252))
    texts = [f"{form} {' '.join(rng.choices(wide, k=48))}" for _ in range(600)]
    near = []
    for k in range(40):
        own = texts[k].split()
        same = 252 + rng.randint(8, 14)
        near.append(" ".join(own[:same] + rng.choices(wide, k=300 - same)))
    alike = [len(_set(a) & _set(b)) / len(_set(a) | _set(b)) for a, b in zip(texts, near, strict=False)]
    assert min(alike) >= 0.75 and max(alike) < 0.8
    assert 0.70 < len(_set(texts[0]) & _set(texts[1])) / len(_set(texts[0]) | _set(texts[1])) < 0.75
    rows = list(enumerate(texts + near))
    _check_components(neardup.near_duplicates(docs(rows)), rows)


def test_rows_that_share_an_id_are_decided_by_their_own_text(docs):
    rng = random.Random(13)
    a, alone, p, q = (_prose(rng, 60) for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, alone), (5, p), (5, q), (5, q.upper()), (7, p + " end"), (8, q + " end"), (9, alone + " end"), (10, ""), (10, None), (10, a)]
    left = neardup.without_near_duplicates(docs(rows, clash=True))
    assert left.columns == docs(rows, clash=True).columns
    kept = [(r.doc_id, r.text or "") for r in left.collect()]
    assert sorted((d, t) for d, t in kept) == sorted([(1, a), (2, alone), (5, p), (5, min(q, q.upper())), (10, "")])
    component = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(docs(rows)).collect()}
    assert [component[i, 57] for i in (2, 7, 8, 9)] == [1, 5, 5, 2]


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    chain = list(range(300))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(40)
    got = {r.node: r.component for r in components.components(frame).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, **{1001 + i: 1000 for i in range(300)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---- Repeated passages -----------------------------------------------------------------------------------------------


def _removed(texts, length=repeats.LENGTH):
    data = [(text or "").encode() for text in texts]
    times = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _check_repeats(docs, rows, clash=False):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs(rows, clash)).collect())
    assert got == sorted((str(doc_id), *found) for (doc_id, _), found in zip(rows, _removed([text for _, text in rows]), strict=True))


def _letters(rng, count):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=count))


def test_repeats_odd_rows(docs):
    rng = random.Random(5)
    base = _letters(rng, 3000)
    other = _letters(rng, 2000)
    rows = [(1, "a" * 3000), (2, "ab" * 900), (3, None), (4, ""), (5, _letters(rng, 399)), (6, base), (None, other), (None, other), (8, other[:1200]), (8, other[:1200])]
    rows += [(9, base[:1500] + "#" + base[1500:]), (10, other[700:1500] + other[900:1900]), (12, "a" * 400), (13, base[1000:1400]), (14, base[1000:1399]), (15, "é" * 700)]
    rows += [(17, "b" * 399 + "c"), (18, "b" * 399 + "cd"), (19, "z" + base[5:405] + "z"), (20, _letters(rng, 30_000))]
    _check_repeats(docs, rows, clash=True)


def test_repeats_of_nothing(docs):
    assert repeats.digest(docs([])).collect() == []


def test_repeats_of_cut_and_pasted_texts(docs):
    rng = random.Random(6)
    base = [_letters(rng, 2500) for _ in range(3)]
    rows = []
    for k in range(70):
        text = rng.choice(base)
        a, b, c, d = sorted(rng.randrange(2500) for _ in range(4))
        rows.append((k, text[:a] + _letters(rng, rng.randint(0, 30)) + text[a:c] + text[b:d]))
    rows += [(100 + k, _letters(rng, rng.randint(0, 900))) for k in range(20)]
    _check_repeats(docs, rows)


@pytest.mark.parametrize("starts", [500, 1111])
def test_repeats_of_texts_longer_than_a_piece(docs, monkeypatch, starts):
    """Long texts are worked on in pieces; strings that lie across two of them are found as well."""
    monkeypatch.setattr(repeats, "STARTS", starts)
    monkeypatch.setattr(repeats, "ENTRIES", 3)
    rng = random.Random(8)
    base = [_letters(rng, 2500) for _ in range(2)]
    rows = []
    for k in range(30):
        a, b = sorted(rng.randrange(2500) for _ in range(2))
        rows.append((k, _letters(rng, rng.randint(0, 900)) + rng.choice(base)[a:b] + _letters(rng, 30) + rng.choice(base)))
    rows += [(30, base[0]), (30, base[0]), (31, "a" * 3000), (32, _letters(rng, starts)), (33, _letters(rng, starts + 399)), (34, base[1][:starts] + base[1][:starts])]
    _check_repeats(docs, rows)


def test_a_piece_of_a_long_text_is_no_longer_than_its_strings_need():
    text = _letters(random.Random(9), 10_000)
    found = list(repeats.pieces(pa.array(["short", None, text, "b" * 399]), 1000))
    assert max(len(data) for _, _, data, _ in found) == 1000 + repeats.LENGTH - 1
    held = [begin + s for i, begin, data, _ in found if i == 2 and len(data) >= repeats.LENGTH for s in range(len(data) - repeats.LENGTH + 1)]
    assert held == list(range(10_000 - repeats.LENGTH + 1))
    assert all(data.tobytes() == text[begin : begin + len(data)].encode() for i, begin, data, _ in found if i == 2)


def test_clean_texts_stay_whole(docs):
    rng = random.Random(7)
    rows = [(k, _letters(rng, 1500)) for k in range(40)]
    assert all(r.n_removed == 0 for r in repeats.digest(docs(rows)).collect())


# ---- Leaks -----------------------------------------------------------------------------------------------------------


def _plain_tiles(text, item, least):
    """Greedy string tiling as it is defined: the longest unmarked match first."""
    in_text, in_item, total = [False] * len(text), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not in_item[p + k] and not in_text[t + k]:
                    k += 1
                if (k, -t, -p) > (best[0], -best[1], -best[2]):
                    best = (k, t, p)
        k, t, p = best
        if k < least:
            return total
        in_text[t : t + k], in_item[p : p + k] = [True] * k, [True] * k
        total += k


def _leaks(rows, items):
    found = set()
    for doc_id, text in rows:
        own = re.findall(r"[a-z0-9\u0080-￿]+", (text or "").translate(ASCII_LOWER))
        for item_id, item in items:
            theirs = re.findall(r"[a-z0-9\u0080-￿]+", (item or "").translate(ASCII_LOWER))
            covered = _plain_tiles(own, theirs, decontamination.SEED) if theirs else 0
            if theirs and covered >= decontamination.COVERAGE * len(theirs) and covered:
                found.add((str(doc_id), item_id, covered))
    return found


def _items(spark, items):
    return spark.createDataFrame([(*item, 1) for item in items], "item_id bigint, text string, score int")


def test_leaks_agree_with_plain_tiling(spark, docs):
    rng = random.Random(8)
    small = VOCABULARY[:12]
    items = [(k, " ".join(rng.choices(small if k % 2 else VOCABULARY, k=rng.randint(3, 40)))) for k in range(14)] + [(50, None), (51, ""), (52, "a b c")]
    rows = []
    for k in range(60):
        _, item = rng.choice(items[:14])
        own = item.split()
        cut = rng.randint(0, len(own))
        moved = own[cut:] + rng.choices(VOCABULARY, k=rng.randint(0, 9)) + own[:cut]  # reordered
        if k % 3 == 0:
            moved[rng.randrange(len(moved))] = "other"
        rows.append((k, f"{_prose(rng, 20)} {' '.join(moved)}, {_prose(rng, 20)}".replace("w1 ", "W1, ")))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, " ".join(rng.choices(small, k=300))), (102, items[2][1])]
    frame = decontamination.leaks(docs(rows, clash=True), _items(spark, items))
    assert {(str(r.doc_id), r.item_id, r.covered_words) for r in frame.collect()} == _leaks(rows, items)
    clean = decontamination.without_leaks(docs(rows, clash=True), _items(spark, items))
    leaking = {doc_id for doc_id, _, _ in _leaks(rows, items)}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t in rows if str(d) not in leaking or (d == 102 and t != items[2][1] and not _leaks([(d, t)], items)))
    assert clean.columns == docs(rows, clash=True).columns


def test_leaks_of_words_that_repeat(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "HELD", 1000)
    items = [(1, "a " * 60), (2, "a b " * 30), (3, "a a a a a a b a a a a a a")]
    rows = [(1, "a " * 200), (2, "b a " * 90), (3, "a a a a a a a b"), (4, "x " + "a " * 44), (5, "x " + "a " * 45), (6, "a a a a a a c b a a a a a a")]
    frame = decontamination.leaks(docs(rows), _items(spark, items))
    assert {(str(r.doc_id), r.item_id, r.covered_words) for r in frame.collect()} == _leaks(rows, items)
    long = decontamination.leaks(docs([(9, "a " * 30_000)]), _items(spark, [(1, "a " * 90)])).collect()
    assert [(r.doc_id, r.covered_words) for r in long] == [(9, 90)]


def test_leaks_in_several_passes(spark, docs, monkeypatch):
    rng = random.Random(9)
    items = [(k, _prose(rng, 20)) for k in range(12)]
    rows = [(k, f"{_prose(rng, 9)} {items[k % 12][1]} {_prose(rng, 9)}") for k in range(24)] + [(99, _prose(rng, 80))]
    monkeypatch.setattr(decontamination, "PER_PASS", 60)
    frame = decontamination.leaks(docs(rows), _items(spark, items))
    assert {(str(r.doc_id), r.item_id, r.covered_words) for r in frame.collect()} == _leaks(rows, items)
    assert [r.doc_id for r in decontamination.without_leaks(docs(rows), _items(spark, items)).collect()] == [99]


def test_leaks_of_nothing(spark, docs):
    assert decontamination.leaks(docs([]), _items(spark, [(1, "a b c d e f")])).collect() == []
    assert decontamination.leaks(docs([(1, "a b c d e f")]), _items(spark, [])).collect() == []
    assert decontamination.without_leaks(docs([(1, "a b c d e f")]), _items(spark, [])).count() == 1


# ---- Licenses --------------------------------------------------------------------------------------------------------


def test_licenses_are_found_wherever_they_stand(docs):
    rng = random.Random(10)
    rows, wanted = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        broken = text.upper().replace(" ", "\n", 3)
        for at, before in enumerate((0, 7, 1000)):
            rows.append((10 * k + at, f"{_prose(rng, before)} {broken} {_prose(rng, 50)}"))
            wanted.add((10 * k + at, name))
    rows += [(9000 + k, _prose(rng, 400)) for k in range(30)] + [(9990, None), (9991, ""), (None, licenses.TEMPLATES["MIT"])]
    found = licenses.scan(docs(rows, clash=True)).collect()
    assert wanted <= {(r.doc_id, r.license) for r in found}
    assert all(r.contained >= licenses.CONTAINED for r in found)
    assert not any(r.doc_id is not None and r.doc_id >= 9000 for r in found) and any(r.doc_id is None for r in found)


def test_licenses_agree_with_plain_containment(docs):
    """Edited copies: what is reported holds enough of the template, and what a stretch holds enough of is reported."""
    rng = random.Random(11)
    template = licenses.TEMPLATES["Apache-2.0"]
    own = _words(re.sub(r"[^\w]+", " ", template))
    wanted = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    rows, share = [], {}
    for k in range(60):
        copy = own[:]
        for _ in range(k // 12):
            copy[rng.randrange(len(copy))] = "zzz"
        rows.append((k, f"{_prose(rng, rng.randint(0, 90))} {' '.join(copy)} {_prose(rng, 60)}"))
        share[k] = len(wanted & {tuple(copy[i : i + 5]) for i in range(len(copy) - 4)}) / len(wanted)
    found = {r.doc_id: r.contained for r in licenses.scan(docs(rows)).collect() if r.license == "Apache-2.0"}
    assert set(found) == {k for k, s in share.items() if s >= licenses.CONTAINED}
    assert all(abs(found[k] - share[k]) < 1e-9 for k in found)


def test_headers_and_identifiers_of_more_licenses(docs):
    notices = {
        "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX MIT": "// SPDX-License-Identifier: MIT",
        "SPDX LGPL-2.1-or-later": "# SPDX-License-Identifier: LGPL-2.1-or-later",
    }
    rng = random.Random(14)
    rows = [(k, f"{_prose(rng, 40)}\n{text}\n{_prose(rng, 40)}") for k, text in enumerate(notices.values())]
    found = {(r.doc_id, r.license): r.contained for r in licenses.scan(docs(rows)).collect()}
    assert all(found.get((k, name)) == 1.0 for k, name in enumerate(notices))
    assert not {name for k, name in found if name.startswith("SPDX")} - set(notices)


def test_band_settings_keep_their_promise():
    for size in (1, 2, 3, 4, 5, 8, 9, 40, 129):
        assert (1 - licenses.similarity(size)) ** licenses.bands(size) <= licenses.MISS


def test_licenses_of_nothing(docs):
    assert licenses.scan(docs([])).collect() == []
    with pytest.raises(ValueError):
        licenses.Scanner({str(k): "a b c d e" for k in range(licenses.MOST_TEMPLATES + 1)})
