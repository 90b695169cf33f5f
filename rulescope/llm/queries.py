"""The registered query of each operator, with production parameters, over
its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulescope.llm import (
    bpe_codec,
    fill_in_middle,
    html_text,
    near_dedup,
    packing,
    pii,
    quality_rules,
    substring_dedup,
    token_counts,
    token_files,
    topk_search,
    toxicity,
    vector_codes,
)
from rulescope.llm.common import table

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 4096


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = html_text.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled transducer."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document by the rank file and decodes the ids."""
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe_codec.decode(encoded, ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte of a 100-byte string that also starts earlier."""
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids as Huffman-coded blocks, reads them back."""
    read = token_files.roundtrip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.counts(pii.find(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of up to 2,048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.assess(table(spark, sf_dir, "documents")).drop("cleaned")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector, and the codebooks' hash."""
    codes, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_hash(codebooks)).alias("codebooks_sha256")
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text rebuilt from it."""
    return fill_in_middle.transform(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_topk_search,
        op3_html_text,
        op4_token_counts,
        op5_bpe_codec,
        op6_substring_dedup,
        op7_token_files,
        op8_pii,
        op9_packing,
        op10_quality_rules,
        op11_vector_codes,
        op12_fill_in_middle,
        op13_toxicity,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_vector_codes": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            )
        ), part AS MATERIALIZED (
            SELECT r, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x FROM v, range(16) t(p)
        ), book0 AS MATERIALIZED (
            SELECT p, r - 1 AS e, x FROM part WHERE r <= 64
        ), near0 AS MATERIALIZED (
            {near0}
        ), book1 AS MATERIALIZED (
            {book1}
        ), near1 AS MATERIALIZED (
            {near1}
        ), book2 AS MATERIALIZED (
            {book2}
        ), near2 AS MATERIALIZED (
            {near2}
        ), coded AS (
            SELECT v.r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d2) AS BIGINT) AS error
            FROM near2 JOIN v USING (r) GROUP BY ALL
        ), hashed AS (
            SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
            FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM book2)
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded, hashed
    """,
    "op12_fill_in_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units
            FROM documents
        ), d AS (
            SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
            FROM t
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50
                    THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), s AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                array_to_string(units[b + 1:n], '') AS suffix
            FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
            CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text
                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
        FROM s
    """,
}


def _vector_codes_sql(sql: str) -> str:
    """Fills in the two steps of a round of plain k-means on all parts."""
    near = """SELECT r, p, arg_min(e, d2 * 64 + e) AS e, min(d2) AS d2 FROM (
                SELECT r, part.p, e, list_sum(list_transform(range(1, len(part.x) + 1), lambda i: (part.x[i] - b.x[i]) ** 2))::BIGINT AS d2
                FROM part JOIN {book} b USING (p)
            ) GROUP BY r, p"""
    book = """SELECT p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
                SELECT p, e, list(q ORDER BY i) AS x FROM (
                    SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (
                        SELECT p, e, i, sum(c) AS s, count(*) AS n
                        FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM part JOIN {near} USING (r, p))
                        GROUP BY p, e, i
                    )
                ) GROUP BY p, e
            ) m USING (p, e)"""
    steps = {f"near{k}": near.format(book=f"book{k}") for k in range(3)}
    steps |= {f"book{k + 1}": book.format(book=f"book{k}", near=f"near{k}") for k in range(2)}
    return sql.format(**steps)


ORACLE_SQL["op11_vector_codes"] = _vector_codes_sql(ORACLE_SQL["op11_vector_codes"])
