"""The queries of these operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, licences, lines, mixing, packing, quality, sharding, simhash, suffixes, toxicity

#: The vocabulary file that packing counts tokens with.
VOCABULARY = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_documents(spark, sf_dir), keep=["doc_id"])
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged.select(F.col("row.doc_id").alias("doc_id"), *figures)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary_path(), 2048)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(_documents(spark, sf_dir), 400, keep=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_documents(spark, sf_dir), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_sentences", "sequence", "licence", "kind", "licences")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), words=3, bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def source_weights(sources: list) -> list[int]:
    return [1 + k % 3 for k in range(len(sources))]


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("doc_id"), F.xxhash64("text")]
    drawn = mixing.mix(_documents(spark, sf_dir), source_weights, order=order, keep=["doc_id"])
    shards = F.transform("placements", lambda p: p["shard"]).alias("shards")
    return drawn.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), shards
    )


def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"doc_id": F.col("doc_id"), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)}
    dealt = sharding.shard(_documents(spark, sf_dir), 16, F.col("text"), [F.col("doc_id"), F.xxhash64("text")], carry=carry)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    carry = {"text_sha256": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)}
    return exact.exact_duplicates(_documents(spark, sf_dir), carry=carry)


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("row.doc_id").alias("doc_id"), toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_best_fit_packing,
        op3_suffix_dedup,
        op4_license_scan,
        op5_simhash_near_dedup,
        op6_source_mix,
        op7_ring_sharding,
        op8_line_dedup,
        op9_exact_dedup,
        op10_pu_toxicity,
    )
}


def _licence_sql() -> str:
    known = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(licences.SENTENCES))
    tests = [("," + ",(?:[0-9]+,)*".join(map(str, ids)) + ",", name, kind) for name, kind, ids in licences.RULES]
    rules = ", ".join(f"({i}, '{p}', '{name}', '{kind}')" for i, (p, name, kind) in enumerate(tests))
    ends = "regexp_replace({}, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr({}), 'g')"
    return f"""
        WITH known(id, s) AS (VALUES {known}),
        rules(nth, pattern, licence, kind) AS (VALUES {rules}),
        texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        counted AS (
            SELECT r, len(list_filter(list_transform(string_split({ends.format("t", 10)}, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '')) AS n_sentences FROM texts
        ),
        found AS (
            SELECT r, regexp_extract_all(regexp_replace(lower({ends.format("replace(t, chr(1), ' ')", 1)}), '[^a-z0-9\\x01]+', ' ', 'g'), '{licences.known_pattern(licences.SENTENCES)}') AS f FROM texts
        ),
        each AS (SELECT r, unnest(f) AS s, unnest(range(0, len(f))) AS i FROM found),
        sequences AS (SELECT r, ',' || string_agg(known.id::VARCHAR, ',' ORDER BY i) || ',' AS sequence FROM each JOIN known USING (s) GROUP BY r),
        matched AS (SELECT r, licence, kind, nth FROM sequences JOIN rules ON regexp_matches(sequence, pattern)),
        firsts AS (SELECT r, licence, min(nth) AS nth FROM matched GROUP BY r, licence),
        best AS (SELECT r, arg_min(licence, nth) AS licence, arg_min(kind, nth) AS kind FROM matched GROUP BY r),
        lists AS (SELECT r, string_agg(licence, ',' ORDER BY nth) AS licences FROM firsts GROUP BY r)
        SELECT doc_id, n_sentences, coalesce(sequence, '') AS sequence, best.licence, best.kind, coalesce(licences, '') AS licences
        FROM texts JOIN counted USING (r) LEFT JOIN sequences USING (r) LEFT JOIN best USING (r) LEFT JOIN lists USING (r)
    """


SQL = {
    "op4_license_scan": _licence_sql(),
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
