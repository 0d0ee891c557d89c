"""The registered queries of these operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.llm import (
    decontaminate, jaccard_join, licenses, packing, paragraph_dedup, prefix_trie, quality, sharding, suffix_dedup,
    token_files, toxicity, vantage_trees, whitening)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_shards")
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as shard files and read back."""
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"))
    return token_files.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


JUMP_SQL = """
WITH RECURSIVE bits(b, c, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
sums AS (
    SELECT r, doc_id, octet_length(encode(body)) + 8 AS size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(body))), lambda i:
               ('0x' || substr(hex(encode(body)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
               lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM rows_, lookup),
jump(r, shards, state, shard, ahead) AS (
    SELECT r, n, (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT
    FROM sums, (VALUES (24), (25)) AS v(n)
    UNION ALL
    SELECT r, shards, next, ahead,
           CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / ((next // 8589934592) + 1)::DOUBLE)) AS BIGINT)
    FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE ahead < shards)),
ends AS (SELECT r, shards, shard FROM jump WHERE ahead >= shards)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, a.shard::INT AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY s.doc_id, s.text_crc32) - 1 AS slot,
       b.shard::INT AS grown_shard
FROM sums s JOIN ends a ON a.r = s.r AND a.shards = 24 JOIN ends b ON b.r = s.r AND b.shards = 25
"""


@query("op2_jump_shards", JUMP_SQL)
def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards by jump hashing of their ids."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query("op6_packed_sequences")
def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sql_words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION_SQL = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
item AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark),
gram AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS g
    FROM item, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i) WHERE len(w) > 0),
place AS (
    SELECT r, i, n, list_slice(w, i, i + n - 1) AS g
    FROM doc, (SELECT DISTINCT n FROM gram), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT r, i, p.n, item_id FROM place p JOIN gram USING (n, g)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op3_decontamination", DECONTAMINATION_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), "contaminated")


QUALITY_SQL = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM again, LATERAL (SELECT unnest(range(i, i + 3)) AS k) GROUP BY r),
m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(w, lambda x: list_contains({list(quality.STOP_WORDS)},
               lower(regexp_replace(x, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')))))::BIGINT AS n_stop_words,
           len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
           len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines
    FROM doc LEFT JOIN rep USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
       AND n_dup_lines / n_lines <= 0.3 AND n_stop_words >= 2 AND n_letter_words / n_words >= 0.8
       AND n_bullet_lines / n_lines <= 0.9 AS kept
FROM base
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdicts of all documents."""
    return quality.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def license_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM at_ WHERE " + " AND ".join(
            f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in licenses.BASE.items())
    templates = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label FROM joined WHERE regexp_matches(s, ' {licenses.template_pattern(template)}')"
        for label, template in licenses.TEMPLATES.items())
    clauses = ", ".join(f"'{label}'" for label in sorted(licenses.CLAUSES))
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
joined AS (SELECT r, ' ' || coalesce(array_to_string(w, ' '), '') || ' ' AS s FROM doc),
at_ AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
base AS ({phrases}),
own AS ({templates}),
b AS (SELECT r, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM own) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word,
       l::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       CASE WHEN r IN (SELECT r FROM own WHERE label NOT IN ({clauses})) THEN 1.0
            WHEN r IN (SELECT r FROM own) THEN 0.75 WHEN n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM doc LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""


@query("op8_license_templates", license_sql())
def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of all documents."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.concat_ws(",", "base_labels").alias("base_labels"),
                        F.concat_ws(",", "labels").alias("labels"), "score")


@query("op5_toxic_spans")
def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a chain fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by similar sets of four-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query("op4_repeated_strings")
def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that stand in an earlier document, cut out of all documents."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_repeated_paragraphs")
def op7_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that an earlier document has too, cut out of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paragraph_dedup.remove_paragraphs(docs).select(
        "doc_id", "n_paragraphs", "n_removed_paragraphs", "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_vantage_trees")
def op11_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of all embeddings to each whose id is divisible by 50."""
    return vantage_trees.nearest(table(spark, sf_dir, "embeddings"), 5)


@query("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with its group's opening turns."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_whitened_embeddings")
def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the covariance of their distinct quantised vectors, four components."""
    vectors, fit = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return whitening.by_component(vectors, fit).withColumn("deviation", F.col("deviation").try_cast("long"))
