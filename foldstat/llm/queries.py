"""The registered corpus queries: thin digests of the operators' results, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, chat, packing, simhash, substring_dedup, token_files, topk, toxicity, warc
from .common import scratch_path, stored
from .exact_dedup import exact_dedup

#: The tokenizer files of the contracts; the operators take any path.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CHAT = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), usable=~held_out)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("toxic_flag").alias("rejected"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica with planted faults: by page_id, the first byte of some pages is overwritten and some records are gone."""
    p = _table(spark, sf_dir, "pages")
    broken = F.when((p["page_id"] % 97 == 3) & (F.length(p["html"]) > 0), F.overlay(p["html"], F.lit("#"), 1, 1)).otherwise(p["html"])
    own, other = warc.record_of(p["page_id"], p["url"], p["html"]), warc.record_of(p["page_id"], p["url"], broken)
    sha = lambda x: F.unhex(F.sha2(x, 256))
    table = p.select("page_id", F.octet_length(own).cast("long").alias("length"), sha(own).alias("digest"), sha(other).alias("other"), F.coalesce(p["page_id"] % 389 == 5, F.lit(False)).alias("lost"))
    archive = stored(warc.placed(table).withColumn("unit", F.lit("archive")), "archive")
    found = warc.audit(
        archive.select("unit", "offset", "length", "digest"), archive.filter("not lost").select("unit", "offset", "length", F.col("other").alias("digest"))
    ).select(F.col("offset").alias("at"), "status")
    out = archive.join(found, archive["offset"] == found["at"], "left")
    return out.select("page_id", "offset", "length", F.lower(F.hex("digest")).alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), uri, WORDS, end_id=1)
    return token_files.read_token_files(spark, uri, ids=False)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors.filter("vec_id % 20 = 0"), vectors, k=20)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    return chat.read_back(chat.format_chats(table.unionByName(more), CHAT))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORDS, capacity=2048, end_id=0, ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(_table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), k=20)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc_fixity, op3_byte_bpe, op4_token_files, op5_exact_topk, op6_chat_format, op7_packing, op8_simhash, op9_substring_dedup, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    escaped = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"""
    return {
        "op2_warc_fixity": """
            WITH r AS (
                SELECT page_id, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
                       'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || nl
                       || 'WARC-Date: 1970-01-01T00:00:00Z' || nl
                       || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || nl || 'Content-Type: text/html' || nl
                       || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || nl || nl || coalesce(html, '') || nl || nl AS record
                FROM pages),
            t AS (SELECT page_id, html, octet_length(encode(record)) AS length, sha256(record) AS record_sha256 FROM r)
            SELECT page_id,
                   (sum(length) OVER (ORDER BY page_id NULLS FIRST, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length)::BIGINT AS "offset",
                   length::BIGINT AS length, record_sha256,
                   CASE WHEN page_id % 389 = 5 THEN 'missing' WHEN page_id % 97 = 3 AND html <> '' AND left(html, 1) <> '#' THEN 'corrupt' ELSE 'ok' END AS status
            FROM t""",
        "op5_exact_topk": """
            WITH v AS (
                SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
            SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
            WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20""",
        "op6_chat_format": f"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(8 + length({escaped.format("replace(role, chr(10), '!!')")}) + length({escaped.format("text")}))::BIGINT AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op9_substring_dedup": r"""
            WITH d AS (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
            w AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM d),
            g AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 19], ' ') AS gram FROM w),
            r AS (
                SELECT doc_id, pos FROM (
                    SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS nth FROM g) WHERE nth > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS at FROM r),
            a AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM d),
            k AS (
                SELECT a.doc_id, count(*) FILTER (gone.at IS NOT NULL) AS n_removed,
                       string_agg(word, ' ' ORDER BY a.at) FILTER (gone.at IS NULL) AS kept
                FROM a LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.at = gone.at GROUP BY a.doc_id)
            SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
        "op10_exact_dedup": """
            WITH t AS (
                SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
                FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    }
