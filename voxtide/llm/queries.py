"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import (
    decontaminate, langid, licenses, nbest, near_dup, orc_ids, personal, quality, quotes, spelling, token_count,
    topk, vector_codes,
)
from voxtide.session import apply_settings, scratch_path

KEEP_TAIL = 0.5  # least probability of the best grade for a document to stay


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return topk.exact_top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judge(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents"))


def op5_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    linked = quotes.link_quotations(_table(spark, folder, "conversations"), every_part=True)
    return linked.select(
        "conv_id", "turn", "role", "n_quotes", "n_linked", F.array_join("sources", ",").alias("sources"), "parent", "thread", "depth",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


def op6_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_ids_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    orc_ids.write_token_ids(_table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = orc_ids.read_token_ids(spark, path)
    return rows.select("doc_id", "start", "n_tokens", orc_ids.ids_crc32(F.col("ids")).alias("ids_crc32"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    graded = quality.grade_texts(docs, quality_model(docs, labels))
    return graded.select("doc_id", "grading.*", (F.col("grading.tail") >= KEEP_TAIL).alias("kept"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Ordinal:
    rated = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.train(docs, rated)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = langid.predict_language(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op10_nbest(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return nbest.encode_n_best(_table(spark, folder, "documents"), model)


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents"), min_letters=6, min_count=5, times=5, slips=199)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress_with_errors(_table(spark, folder, "embeddings"), n_parts=16, n_entries=64, rounds=2, scale=256.0)


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = personal.find_personal_data(docs, personal.train(docs)).select("doc_id", "personal.base", "personal.spans")
    counts = [personal.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in personal.KINDS]
    digest = F.sha2(personal.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, personal.span_list(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_topk, op2_license_scan, op3_decontaminate, op4_near_dedup, op5_quotation_links, op6_token_count,
        op7_token_ids_orc, op8_quality, op9_language, op10_nbest, op11_spelling_variants,
        op12_vector_codes, op13_personal_data,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
FOUND = ", ".join(f"CASE WHEN regexp_matches(joined, '{licenses.pattern(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES)

SQL = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op2_license_scan": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
        j AS (
            SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS joined,
                list_filter(range(len(words)), lambda i:
                    array_to_string(words[i + 1 : i + 4], ' ') IN ('under the mit license', 'apache license version 2')
                    OR array_to_string(words[i + 1 : i + 3], ' ') = 'cc by nc') AS places
            FROM w
        ), t AS (
            SELECT *, list_filter([
                CASE WHEN joined LIKE '% apache license version 2 %' THEN 'apache-2' END,
                CASE WHEN joined LIKE '% cc by nc %' THEN 'cc-by-nc' END,
                CASE WHEN joined LIKE '% under the mit license %' THEN 'mit' END], lambda x: x IS NOT NULL) AS base,
            list_filter([{FOUND}], lambda x: x IS NOT NULL) AS more
            FROM j
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
            list_max(places)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels, len(more)::BIGINT AS n_templates,
            1 - 1.0::DOUBLE / (1 + len(places) + len(more)) AS score
        FROM t
    """,
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
        b AS (SELECT item_id, {WORDS} AS words FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(13, len(words)) AS size,
                array_to_string(words[i + 1 : i + least(13, len(words))], ' ') AS body
            FROM (SELECT *, unnest(range(len(words) - least(13, len(words)) + 1)) AS i FROM b WHERE len(words) > 0)
        ), dw AS (
            SELECT doc_id, size, i, array_to_string(words[i + 1 : i + size], ' ') AS body
            FROM (
                SELECT doc_id, words, size, unnest(range(len(words) - size + 1)) AS i
                FROM d, (SELECT DISTINCT size FROM bw) WHERE len(words) >= size
            )
        ), hits AS (SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw USING (size, body)),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op4_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 4], ' ') AS shingle
            FROM (SELECT *, unnest(range(greatest(1, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)
        ), reach AS (
            SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
        ), lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id,
            w.doc_id <= coalesce(b, w.doc_id) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON a = w.doc_id
    """,
    "op11_spelling_variants": rf"""
        WITH RECURSIVE r AS (
            SELECT id, run, count(*) AS n
            FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY ALL
        ), b AS (
            SELECT id, run, n, flatten(list_transform(range(length(id || ':' || run)), lambda i: CASE
                WHEN ord((id || ':' || run)[i + 1]) < 128 THEN [ord((id || ':' || run)[i + 1])::BIGINT, 0, 0, 0, 0, 0, 0, 0]
                ELSE [192 + (ord((id || ':' || run)[i + 1]) >> 6)::BIGINT, 0, 0, 0, 0, 0, 0, 0,
                    128 + (ord((id || ':' || run)[i + 1]) & 63)::BIGINT, 0, 0, 0, 0, 0, 0, 0] END)) AS bytes
            FROM r
        ), h AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295::BIGINT) AS h
            FROM b
        ), w AS MATERIALIZED (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), k AS (
            SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS z
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
        ), d AS (SELECT DISTINCT k.word AS longer, k.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM k JOIN w ON a || z = w.word),
        p AS (
            SELECT x.word, x.n, y.word AS other, y.n AS other_n
            FROM k x JOIN k y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
            UNION ALL SELECT longer, longer_n, shorter, shorter_n FROM d UNION ALL SELECT shorter, shorter_n, longer, longer_n FROM d
        ), f AS MATERIALIZED (
            SELECT w.word, w.n, count(other)::BIGINT AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
            FROM w LEFT JOIN p ON p.word = w.word GROUP BY w.word, w.n
        ), g AS (SELECT word, n, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM f),
        e AS (
            SELECT word, word AS root FROM g UNION ALL SELECT e.word, g.form FROM e JOIN g ON g.word = e.root WHERE g.form IS NOT NULL
        ), l AS (SELECT e.word, e.root FROM e JOIN g ON g.word = e.root WHERE g.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM g JOIN l USING (word)
    """,
    "op12_vector_codes": """
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (
            SELECT vec_id, label, part, e[4 * part + 1] AS x0, e[4 * part + 2] AS x1, e[4 * part + 3] AS x2, e[4 * part + 4] AS x3
            FROM v, range(16) t(part)
        ), c0 AS MATERIALIZED (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x0, x1, x2, x3 FROM p
            QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 64
        ), """ + ", ".join(f"""
        a{r} AS MATERIALIZED (
            SELECT p.vec_id, p.label, part, p.x0, p.x1, p.x2, p.x3,
                min(64 * ((p.x0 - c.x0) ** 2 + (p.x1 - c.x1) ** 2 + (p.x2 - c.x2) ** 2 + (p.x3 - c.x3) ** 2)::BIGINT + entry) AS best
            FROM p JOIN c{r} c USING (part) GROUP BY ALL
        )""" + (f""", s{r} AS (
            SELECT part, best % 64 AS entry, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, count(*) AS n FROM a{r} GROUP BY ALL
        ), c{r + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(floor(s0 / n)::BIGINT, x0) AS x0, coalesce(floor(s1 / n)::BIGINT, x1) AS x1,
                coalesce(floor(s2 / n)::BIGINT, x2) AS x2, coalesce(floor(s3 / n)::BIGINT, x3) AS x3
            FROM c{r} LEFT JOIN s{r} USING (part, entry)
        )""" if r < 2 else "") for r in range(3)) + """,
        o AS (
            SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error
            FROM a2 GROUP BY vec_id, label
        ), l AS (SELECT label, sum(error)::BIGINT AS label_error FROM o GROUP BY label),
        h AS (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN l ON o.label IS NOT DISTINCT FROM l.label, h
    """,
}
