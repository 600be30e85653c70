"""Queries of the text-preparation operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm import (conversation_trie, decontaminate, exact_dedup, hard_negatives, language_cnn, piece_codec,
                          quality_gam, secret_scan, signature_join, suffix_dedup, token_counts, token_records,
                          warc_archive)
from shopflow.llm.sampling import not_held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))

    def of(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    def joined(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"] != "lexed")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"),
                        of("hex").alias("n_hex"), of("lexed").alias("n_lexed"),
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))


def op2_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    features = quality_gam.text_features(table(spark, folder, "documents"))
    model = quality_gam.fit(features, table(spark, folder, "labels"), not_held_out())
    held_out = F.coalesce(~not_held_out(), F.lit(False))
    return quality_gam.score(features, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.similar_components(table(spark, folder, "documents"), words=3, numerator=9, denominator=10)


def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_records.write_records(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_records.read_records(manifest).select("doc_id", "start", "n_tokens",
                                                       F.crc32("ids").alias("ids_crc32"))


def op5_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    coded = piece_codec.encode_decode(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_language_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = language_cnn.fit(docs, not_held_out())
    held_out = F.coalesce(~not_held_out(), F.lit(False))
    return language_cnn.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc_archive.write_archives(table(spark, folder, "pages"))
    return warc_archive.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                       "refers_to")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = F.size("found.hit_words").cast("long")
    items = F.array_sort("found.items")
    return marked.select("doc_id", "found.n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                         (hit > 0).alias("contaminated"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, folder, "conversations"),
                                          shared=lambda c: F.crc32(c.cast("string")) % 9,
                                          base=lambda c: c - c % 5, most=8)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_gam": op2_quality_gam,
    "op3_signature_join": op3_signature_join,
    "op4_token_records": op4_token_records,
    "op5_piece_codec": op5_piece_codec,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_cnn": op7_language_cnn,
    "op8_warc_archive": op8_warc_archive,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}

SQL: dict[str, str] = {
    "op8_warc_archive": r"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
""",
    "op9_decontaminate": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS n,
           array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS w
    FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
dw AS (
    SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, w)),
h AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit, count(DISTINCT item_id) AS n_items,
           array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items
    FROM (SELECT *, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id)
""",
    "op10_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM d WINDOW same AS (PARTITION BY norm)
""",
    "op11_conversation_trie": r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
               length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
seq AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS s FROM t GROUP BY conv_id),
crc AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, s, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                              lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))) % 9 AS h
    FROM seq),
rebuilt AS (
    SELECT a.conv_id AS c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s
    FROM crc a LEFT JOIN seq b ON b.conv_id = a.base),
prefix AS (
    SELECT c, d, len(s) AS own, sha256(s[1:d]::VARCHAR || d) AS id, CASE WHEN d > 0 THEN sha256(s[1:d - 1]::VARCHAR || (d - 1)) END AS up,
           CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS bytes
    FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS (
    SELECT id, d, any_value(up) AS up, any_value(bytes) AS bytes, min(c) AS low, count(*) AS n,
           sha256(coalesce(string_agg(CASE WHEN own = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
    FROM prefix GROUP BY id, d),
kids AS (SELECT up AS id, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
under AS (
    SELECT a.id, count(*) FILTER (WHERE k.id IS NULL) AS n_leaves, sum((v.n - 1) * v.bytes)::BIGINT AS saved
    FROM (SELECT DISTINCT x.id, y.id AS below FROM prefix x JOIN prefix y ON x.c = y.c AND y.d >= x.d) a
    JOIN node v ON v.id = a.below LEFT JOIN kids k ON k.id = v.id GROUP BY a.id)
SELECT node.low AS conv_id, node.d AS depth, above.low AS parent_conv_id, node.n AS n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN under USING (id) LEFT JOIN kids USING (id) LEFT JOIN node above ON above.id = node.up
""",
    "op12_hard_negatives": r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pos AS (
    SELECT a.vec_id AS anchor_id, a.label, a.vec, p.vec_id AS positive_id, list_inner_product(a.vec, p.vec)::BIGINT AS positive_score
    FROM v a JOIN v p ON a.vec_id % 50 = 0 AND a.label = p.label AND a.vec_id <> p.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.vec, p.vec) DESC, p.vec_id) <= 5),
neg AS (
    SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, list_inner_product(pos.vec, n.vec)::BIGINT AS negative_score
    FROM pos JOIN v n ON pos.label <> n.label)
SELECT anchor_id, positive_id, row_number() OVER (
           PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank,
       negative_id, positive_score, negative_score
FROM neg WHERE 50 * positive_score <= 100 * negative_score AND 100 * negative_score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= 3
""",
}
