"""One query per operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildup.llm import ann, bpe, hard_negatives, langid, line_chunks, merkle, mixing, packing, secret_scan, simhash, sketch, token_counts, warc
from buildup.llm.common import table
from buildup.session import new_table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), vocabulary("piece_bpe_32k.model"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
    2.0::DOUBLE * source_size AS cap
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t
), c AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) - sum(size) OVER (PARTITION BY d.source, h) / 2.0 AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN budget > 0 AND middle <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query("op7_mixing", _MIX)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


# five bits of the digest at a time are read from three of its hexadecimal digits
_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) || '0' AS hex FROM pages
), first AS (
  SELECT body, max(page_id) AS first FROM p GROUP BY body
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + (5 * i) // 4, 3))::INTEGER >> (7 - (5 * i) % 4)::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN first USING (body)
"""


@query("op8_warc", _WARC)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, min_bytes=0)
    found = warc.read(spark, path, payloads=False)
    return found.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").alias("n_chars_before"))
    found = line_chunks.dedup_lines(docs)
    return found.select(
        "doc_id",
        "n_chars_before",
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.train(docs))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_edits(table(spark, sf_dir, "documents"))


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op3_token_packing")
def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokenizer = bpe.Tokenizer(spark, vocabulary("word_bpe_49k.json"))
    ids = docs.select("doc_id", tokenizer.encode(F.col("text"), width=2).alias("ids"))
    # a 2-byte id stands for about two bytes of text or more
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    path = new_table_path(spark, "packed")
    packing.write(packing.pack(ids, length=2048, width=2, total_bytes=size), path)
    return packing.read(spark, path).select(
        "shard",
        "row",
        "n_tokens",
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
    )


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def _written(*columns: str) -> str:
    one = "coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(one.format(c=c) for c in columns) + ")"


# the polynomial of CRC-32, a bit at a time
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(i) + 1),
    lambda k: ascii(substr(i, k::INTEGER, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)],
    [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, CAST(doc_id AS VARCHAR) AS i,
    {_written("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    {_written("doc_id", "source", "lang", "n_chars + 1", "text")} AS tampered
  FROM documents
), l AS (
  SELECT rid, doc_id, lang, leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN tampered ELSE leaf END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d
), up AS (
  SELECT 0 AS level, lang, rank, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL
  SELECT level + 1, lang, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), (any_value(n) + 1) // 2
  FROM up WHERE n > 1 GROUP BY level, lang, rank // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank FROM up WHERE n = 1
), over_parts AS (
  SELECT 0 AS level, rank, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), (any_value(n) + 1) // 2
  FROM over_parts WHERE n > 1 GROUP BY level, rank // 2
), steps AS (
  SELECT rid, u.level, s.h AS sibling, (l.rank >> u.level) % 2 = 1 AS on_left
  FROM l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.n > 1 AND u.rank = l.rank >> u.level
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = u.level AND s.rank = xor(u.rank, 1)
  UNION ALL
  SELECT rid, 1000 + u.level, s.h, (r.rank >> u.level) % 2 = 1
  FROM l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  JOIN over_parts u ON u.n > 1 AND u.rank = r.rank >> u.level
  LEFT JOIN over_parts s ON s.level = u.level AND s.rank = xor(u.rank, 1)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k FROM steps
), folded AS (
  SELECT rid, 0::BIGINT AS k, changed AS h FROM l
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN on_left THEN sibling || h ELSE h || sibling END)
  FROM folded f JOIN numbered s ON s.rid = f.rid AND s.k = f.k + 1
), proofs AS (
  SELECT rid, count(*) AS k, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256
  FROM steps GROUP BY rid
)
SELECT doc_id, leaf, subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  f.h AS folded_root, f.h = t.h AS verified
FROM l LEFT JOIN proofs p ON p.rid = l.rid JOIN folded f ON f.rid = l.rid AND f.k = coalesce(p.k, 0)
JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang, over_parts t WHERE t.n = 1
"""


@query("op13_merkle_manifest", _MERKLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(seventh, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(docs, part="lang", order="doc_id", fields=fields, changed={"n_chars": more})
    folded = merkle.fold(F.col("changed_leaf"), F.col("proof"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_hash(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", _NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    scaled = lambda x: 256 * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x)))  # others, NaN too, are null
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(
        rows,
        F.col("vec_id") % 100 == 0,
        id_col="vec_id",
        label=label,
        vector=F.transform("embedding", whole),
        positives=5,
        negatives=10,
        window=(30, 90),
    )
