"""The queries of the operators in this package: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, jpeg, langid, licenses, linededup, mixing, neardup, packing, prefixtrie, substrings, tokenfile, topk, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(spark, table(spark, sf_dir, "pages"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_passages(spark, table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(spark, docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features_column(jpeg.encode_column(table(spark, sf_dir, "documents")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tokenfile.encode_documents(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ids_too=False)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "byte", 0))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(spark, table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(spark, table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_warc_archive, op3_line_dedup, op4_language_id, op5_license_scan,
        op6_progressive_jpeg, op7_near_duplicates, op8_topk_search, op9_token_files, op10_pattern_packing,
        op11_token_alignment, op12_prefix_trie, op13_substring_dedup,
    )
}

_WARC = """
    WITH p AS (SELECT page_id, url, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS holder FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
        CASE WHEN holder IS DISTINCT FROM page_id AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to, url
    FROM p LEFT JOIN f USING (payload_digest)"""

_TOPK = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

#: crc32 bit by bit, over the digits.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda y, i: xor(y >> 1, CAST(3988292384 AS BIGINT) * (y & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)))"""

_TRIE = f"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS donor, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (
        SELECT c.conv_id, t.i AS p, role, text FROM c JOIN t ON t.conv_id = c.donor AND t.i < c.h
        UNION ALL SELECT conv_id, i + 6, role, text FROM t JOIN c USING (conv_id) WHERE i >= h),
    o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth, role, text FROM r),
    k AS (SELECT conv_id, depth, text, sha256(string_agg(len(role) || ' ' || len(text) || ' ' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM o),
    a AS (
        SELECT conv_id, depth, len(text) AS size, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS over FROM k
        UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
    n AS (SELECT key, depth, over, size, min(conv_id) AS conv_id, count(*) AS n_convs FROM a GROUP BY ALL),
    kids AS (SELECT over AS key, count(*) AS n_children FROM n WHERE over IS NOT NULL GROUP BY 1),
    s AS (
        SELECT a.key, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n.size) AS saved_tokens
        FROM n LEFT JOIN kids USING (key) JOIN a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY 1),
    e AS (
        SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM a JOIN (SELECT conv_id, max(depth) AS depth FROM a GROUP BY 1) USING (conv_id, depth) GROUP BY 1)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
        CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN s USING (key) LEFT JOIN kids USING (key) LEFT JOIN e USING (key) LEFT JOIN n p ON p.key = n.over"""

_SUBSTRINGS = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    t AS (
        SELECT doc_id, unnest(range(1, greatest(len(words) - 11, 1))) AS i,
            unnest(list_transform(range(1, greatest(len(words) - 11, 1)), lambda i: array_to_string(words[i:i + 12], ' '))) AS passage FROM w),
    m AS (SELECT passage, min(doc_id) AS least FROM t GROUP BY 1),
    g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM t JOIN m USING (passage), range(13) AS r(j) WHERE doc_id > least GROUP BY 1)
    SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
        sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
    FROM w LEFT JOIN g USING (doc_id)"""

ORACLE_SQL = {"op12_prefix_trie": _TRIE, "op13_substring_dedup": _SUBSTRINGS, "op2_warc_archive": _WARC, "op5_license_scan": licenses.scan_sql(), "op8_topk_search": _TOPK}
