"""The numbered operators as queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from workpulse.llm import alignment, decontamination, language, licenses, mixing, naming, neardup, quality, repair, repeats, tokenids, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages"))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenids.VOCABULARY))


def op11_identity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in (alignment.BYTE_VOCABULARY, alignment.PIECE_MODEL)]
    return alignment.digest(_table(spark, sf_dir, "documents"), *paths)


def op12_deepening_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_lsh_forest": op2_lsh_forest,
    "op3_quadratic_discriminant": op3_quadratic_discriminant,
    "op4_family_svm": op4_family_svm,
    "op5_pivot_topk": op5_pivot_topk,
    "op6_license_windows": op6_license_windows,
    "op7_string_tiling": op7_string_tiling,
    "op8_pareto_mix": op8_pareto_mix,
    "op9_prefix_free_parsing": op9_prefix_free_parsing,
    "op10_simple8b": op10_simple8b,
    "op11_identity_map": op11_identity_map,
    "op12_deepening_repair": op12_deepening_repair,
    "op13_block_naming": op13_block_naming,
}


def _repair_sql() -> str:
    """Cheapest edits by dynamic programming: by row and state (0 nothing, 1 system, 2 user, 3 assistant) the least `cost, letters`, the cost in nine digits."""

    def longer(best, edit, cost):
        return f"(lpad(({best}[1:9]::INTEGER + {cost})::VARCHAR, 9, '0') || {best}[10:] || '{edit}')"

    def inserted(b):
        def once(x):
            return [x[0], x[1], f"least({x[2]}, {', '.join(longer(x[q], 'I', 2) for q in (0, 1, 3))})", f"least({x[3]}, {longer(x[2], 'I', 2)})"]

        return once(b)

    names = [f"b{q}" for q in range(4)]
    first, second = [f"{x} AS {n}" for x, n in zip(inserted(names), names, strict=True)], [f"{x} AS {n}" for x, n in zip(inserted(names), names, strict=True)]
    free, short = "fault <> 'B' AND fault <> 'D'", "CASE WHEN fault = 'T' THEN 1 ELSE 0 END"

    def kept(q, initial):
        return f"CASE WHEN {free} AND initial = '{initial}' THEN {longer(f'b{q}', 'K', short)} END"

    def given(q):
        return f"CASE WHEN {free} THEN {longer(f'b{q}', 'R', f'2 + {short}')} END"

    after = [
        longer("b0", "D", 3),
        f"least({longer('b1', 'D', 3)}, {kept(0, 's')})",
        f"least({longer('b2', 'D', 3)}, {', '.join(kept(q, 'u') for q in (0, 1, 3))}, {', '.join(given(q) for q in (0, 1, 3))})",
        f"least({longer('b3', 'D', 3)}, {kept(2, 'a')}, {given(2)})",
    ]
    return rf"""
        WITH RECURSIVE checks AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                    lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
            FROM conversations, checks
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM keyed WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, role[1:1] AS initial,
                rtrim(text, E' 	

')[-1:] AS final, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
            FROM damaged
        ), rows AS (
            SELECT *, CASE WHEN final = '' THEN 'B' WHEN seen THEN 'D' WHEN final NOT IN ('.', '!', '?') THEN 'T' ELSE '-' END AS fault,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd
            FROM placed
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank,
                count(*) FILTER (fault = 'D') AS duplicate, count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (odd) AS illegal
            FROM rows GROUP BY conv_id
        ), searched AS (
            SELECT conv_id, n, 1::BIGINT AS i, '000000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM counted
            UNION ALL
            SELECT conv_id, n, i + 1, {", ".join(after)}
            FROM (SELECT conv_id, n, i, initial, fault, {", ".join(second)} FROM (
                SELECT s.conv_id, s.n, s.i, r.initial, r.fault, {", ".join(first)}
                FROM searched s JOIN rows r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i))
        ), ended AS (
            SELECT conv_id, least(b0, b3) AS best FROM (SELECT conv_id, {", ".join(second)} FROM (
                SELECT conv_id, {", ".join(first)} FROM searched WHERE i = n + 1))
        ), replayed AS (
            SELECT conv_id, best[10:] AS audit, 1::BIGINT AS pos, 1::BIGINT AS i, 0 AS state, []::VARCHAR[] AS lines FROM ended
            UNION ALL
            SELECT conv_id, audit, pos + 1, i + (edit <> 'I')::INTEGER, next,
                CASE WHEN edit = 'D' THEN lines ELSE list_append(lines, CASE WHEN edit = 'K' THEN role ELSE ['user', 'assistant'][next - 1] END || ':'
                    || CASE WHEN edit = 'I' THEN '' ELSE text END) END
            FROM (SELECT *, CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END AS next FROM (
                SELECT p.*, p.audit[p.pos:p.pos] AS edit, r.role, r.text, r.initial
                FROM replayed p LEFT JOIN rows r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i WHERE p.pos <= length(p.audit)))
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(best[1:9]::BIGINT, 0) AS cost, coalesce(best[10:], '') AS audit,
            sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN replayed p ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = length(p.audit) + 1
    """

SQL = {
    "op8_pareto_mix": rf"""
        WITH sizes AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents
        ), drawn AS (
            SELECT *, (('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || mark)[1:12])::BIGINT + 0.5::DOUBLE)
                / 281474976710656.0::DOUBLE AS u, floor(sqrt(sqrt(greatest(size, 1)::DOUBLE)) * {mixing.PULL}.0::DOUBLE)::BIGINT AS pull FROM sizes
        ), weighed AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1)::INTEGER % 3 + 1] AS weight FROM sizes GROUP BY source
        ), ordered AS (
            SELECT *, coalesce(sum(2 * source_size) OVER below, 0) AS stopped, coalesce(sum(weight) OVER below, 0) AS gone,
                sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, row_number() OVER along AS place
            FROM weighed WINDOW along AS (ORDER BY 2.0::DOUBLE * source_size / weight, source),
                below AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), levels AS (
            SELECT place, weight, source_size, (total * 1.5::DOUBLE - stopped) / (weights - gone)::DOUBLE AS level FROM ordered
        ), level AS (
            SELECT coalesce((SELECT level FROM levels WHERE weight * level < 2 * source_size ORDER BY place LIMIT 1),
                (SELECT max(2.0::DOUBLE * source_size) FROM levels)) AS level
        ), wanted AS (
            SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target FROM weighed, level
        ), tried AS (
            SELECT source, size, pull, n, (target - 2 * coalesce(sum(n * size) OVER larger, 0)::DOUBLE)
                / (sum(n * size * pull) OVER (PARTITION BY source) - coalesce(sum(n * size * pull) OVER larger, 0))::DOUBLE AS try
            FROM (SELECT source, size, pull, count(*) AS n FROM drawn WHERE size > 0 GROUP BY ALL) JOIN wanted USING (source)
            WINDOW larger AS (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), rates AS (
            SELECT source, arg_max(try, size) AS rate FROM tried WHERE try * pull < 2 GROUP BY source
        ), ranked AS (
            SELECT *, CASE WHEN expected > whole THEN (u / (1 - u)) / ((expected - whole) / (1 - (expected - whole))) END AS rank, sum(whole * size) OVER (PARTITION BY source) AS certain
            FROM (SELECT *, floor(expected) AS whole FROM (
                SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN rate IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, rate * pull) END AS expected
                FROM drawn d JOIN wanted s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source))
        ), summed AS (
            SELECT *, target - certain AS wanted, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id) AS upto,
                sum(size) OVER (PARTITION BY source, rank, doc_id) AS peers FROM ranked
        )
        SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM (
            SELECT *, (whole + CASE WHEN rank IS NOT NULL AND upto - peers < wanted AND abs(upto - wanted) <= abs(upto - peers - wanted)
                THEN 1 ELSE 0 END)::INTEGER AS copies FROM summed)
    """,
    "op1_warc": """
        WITH rows AS (
            SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages
        ), kept AS (
            SELECT digest, max(page_id) AS kept FROM rows WHERE size >= 1000 GROUP BY digest
        )
        SELECT page_id, size AS payload_bytes, rows.digest AS payload_digest,
            CASE WHEN kept IS NOT NULL AND (page_id IS NULL OR page_id < kept) THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS NULL OR page_id < kept THEN kept END AS refers_to
        FROM rows LEFT JOIN kept ON rows.digest = kept.digest
    """,
    "op2_lsh_forest": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '{mixing.WORD}') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
                THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))
                WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS s FROM worded
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM sets WHERE doc_id IS NOT NULL
            UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
        ), parts AS (
            SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(s.doc_id = component_id, true) AS kept
        FROM sets s LEFT JOIN parts p ON s.doc_id = p.doc_id
    """,
    "op5_pivot_topk": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op13_block_naming": r"""
        WITH plain AS (
            SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g') AS p FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER along AS keep_id, count(*) OVER (PARTITION BY p) AS group_size,
            row_number() OVER along = 1 AS kept, sha256(p) AS text_sha256
        FROM plain WINDOW along AS (PARTITION BY p ORDER BY points DESC, doc_id NULLS LAST)
    """,
    "op12_deepening_repair": _repair_sql(),
}
