"""The registered queries against SQL, and the pipeline against its stages' brute-force versions."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from workpulse.llm import language, queries, tokenids

from test_duplicates import _components, _leaks
from test_models_and_mixes import _targets

TABLES = "documents embeddings pages benchmark labels conversations"


def test_every_operator_is_registered_once():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_ids"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(name, spark, sf_dir):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = connection.execute(queries.SQL[name])
    found = [column[0] for column in cursor.description]
    assert sorted(found) == columns
    ours = collections.Counter(tuple((type(r[c]), r[c]) for c in columns) for r in frame.collect())
    theirs = collections.Counter(tuple((type(r[found.index(c)]), r[found.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


def test_pipeline_agrees_with_its_stages(spark, sf_dir):
    small = sf_dir.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # Language: texts without a letter go, and longer ones that no family's machine claims.
    model = language.fit(docs)

    def claimed(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        lettered = any(c.isalpha() for c in text or "")
        return lettered and (len(data) < 200 or model.predict(language.features(data, np.array([0, len(data)])))[2][0] >= 0.15)

    kept = [(i, r.text) for i, r in rows.items() if claimed(r.text)]
    assert len(kept) >= 0.97 * len(rows)
    # Near-duplicates: the smallest id of each component.
    first = {d for d, _, c in _components(kept) if d == c}
    kept = [(i, t) for i, t in kept if str(i) in first]
    # Leaks.
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    words = {i: set(t.lower().split()) for i, t in kept}
    near = [(i, t) for i, t in kept if any(len(words[i] & set(b.lower().split())) >= 0.5 * len(set(b.lower().split())) for _, b in benchmark)]
    leaking = {d for d, _, _ in _leaks([(i, t) for i, t in near if len(t) < 6000], benchmark)}
    # The pipeline, stage by stage.
    frames, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, small), name)
        frames[name] = now
        if name != "token_ids":
            assert now.columns == docs.columns
    assert sorted(r.doc_id for r in frames["near_dedup"].collect()) == sorted(i for i, _ in kept)
    clean = {str(r.doc_id) for r in frames["decontaminate"].collect()}
    assert not clean & leaking and len(kept) - len(clean) <= len(near)
    sizes = collections.Counter()
    for r in frames["decontaminate"].collect():
        sizes[r.source] += len(r.text.split())
    wanted, got, longest = _targets(sizes), collections.Counter(), collections.Counter()
    for r in frames["mix_sources"].collect():
        got[r.source] += len(r.text.split())
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    assert all(abs(got[s] - wanted[s]) <= max(longest[s], 3000) for s in wanted)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenids.VOCABULARY))
    expected = collections.Counter()
    for r in frames["mix_sources"].collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        expected[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    last = frames["token_ids"].orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in last) == expected
    assert [r.start for r in last] == [0, *np.cumsum([r.n_tokens for r in last])[:-1].tolist()]
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, last))


def test_pipeline_of_nothing(spark, docs, sf_dir):
    now = docs([])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
    assert now.collect() == []
