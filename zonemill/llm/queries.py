"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonemill.llm import align, langid, lattice, mih, neardup, owners, packing, pii, quality, runs, simple8b, warc, winnow
from zonemill.llm.store import place
from zonemill.llm.tokens import encoder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_near_duplicates", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""")
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), percent=85)


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"), _remainder(3) != 1)
    score = F.col("quality_score")
    return quality.scored(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, length=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = place(spark, "simple8b")
    simple8b.write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return simple8b.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.fingerprint_report(table(spark, folder, "documents"))


@query("op7_warc", """
WITH payload AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM payload)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM marked""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    arcs, warcs = place(spark, "arc"), place(spark, "warc")
    warc.pages_to_arc(table(spark, folder, "pages"), arcs)
    warc.convert(spark, arcs, warcs, warc.page_of())
    return warc.page_digests(warc.read_warc(spark, warcs))


@query("op8_language")
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, _remainder(4) != 2)
    return langid.identified(docs.select("doc_id", "text"), model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op9_nearest")
def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return mih.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = lattice.encode(table(spark, folder, "documents"), model)
    return lattice.decode(coded, model).select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_exact_duplicates", r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
owned AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM owned""")
def op11_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return owners.exact_duplicates(table(spark, folder, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.report(runs.periodic_runs(runs.repeated_tails(table(spark, folder, "documents"))))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.report(align.alignments(table(spark, folder, "documents"), a, b), width=len(encoder(b).pieces))
