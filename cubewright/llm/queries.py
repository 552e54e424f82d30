"""The corpus operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exactdedup, mixing, pagediff, pii, quotes, simhash, tokencount, toxicity, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"), exactdedup.new_index(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_decontaminate, op3_token_counts, op4_quotation_linking, op5_mixing, op6_pii, op7_exact_dedup, op8_toxicity, op9_page_differencing, op10_warc, pipeline)
}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, {5 * g + 1}, 5))::INT >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
#: Seeds of its own: of 13 words that differ in two, four in a row are equal (for items of 13 words and more).
_OP2_SQL = f"""
    WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS h FROM documents),
         t AS (SELECT DISTINCT item_id, {_WORDS} AS b FROM benchmark),
         dw AS (SELECT doc_id, h, pos, array_to_string(h[pos + 1 : pos + 4], ' ') AS key FROM (SELECT *, unnest(range(0, len(h) - 3)) AS pos FROM d)),
         tw AS (SELECT item_id, b, pos, array_to_string(b[pos + 1 : pos + 4], ' ') AS key FROM (SELECT *, unnest(range(0, len(b) - 3)) AS pos FROM t)),
         hits AS (SELECT DISTINCT doc_id, item_id, h, b, dw.pos - tw.pos AS shift, least(len(b), {decontaminate.STRETCH}) AS need FROM dw JOIN tw USING (key)),
         same AS (SELECT *, greatest(0, -shift) AS low, list_transform(range(greatest(0, -shift), least(len(b), len(h) - shift)), lambda j: (h[j + shift + 1] = b[j + 1])::INT) AS eq FROM hits),
         sums AS (SELECT *, list_transform(range(0, len(eq) - need + 1), lambda j: list_sum(eq[j + 1 : j + need])) AS s FROM same),
         best AS (SELECT *, list_max(s) AS got, list_position(list_transform(s, lambda x: x >= ceil(need * {decontaminate.SIMILAR})), true) - 1 AS first FROM sums)
    SELECT doc_id, item_id, max(got)::INT AS matched, max(need)::INT AS stretch, min(low + shift + first)::INT AS near_word
    FROM best WHERE got >= ceil(need * {decontaminate.SIMILAR}) GROUP BY doc_id, item_id"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": _OP2_SQL,
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
}
