"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003), in Spark expressions only.

Tokens are runs of letters and digits of the lower-cased text, cut every ``LONGEST`` characters so that text without
spaces has tokens too. Every run of ``k`` tokens is hashed; of every ``window`` consecutive hashes the smallest is
selected, the rightmost of equal ones, with its position. Any passage of ``window + k - 1`` tokens that two texts share
gives a common selected hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
WINDOW = 16
LONGEST = 16
PLACE = (1 << 31) - 1
ROWS = 1000  # documents of a bucket, on average, when neighbours are looked up
BUCKETS = 100_000  # most buckets: bounds what is broadcast


def selected(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Selected hashes with positions, one long each (hash in the upper 31 bits, then the place counted from the end).

    A text of fewer than ``k`` tokens is one k-gram, fewer than ``window`` k-grams are one window, a text without
    tokens has none; null is empty.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}]{{1,{LONGEST}}}"), F.lit(0))
    def from_tokens(words: Column) -> Column:
        n = F.size(words)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.shiftleft(
            F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + (j - 1)) for j in range(k))), 33), 31).bitwiseOR(F.lit(PLACE) - i))
        return F.when(n > 0, _apply(grams, lambda g: F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1))), lambda i: F.array_min(F.slice(g, i, window))))))
    # word hashes first: a k-gram then mixes k longs, not k strings
    return F.coalesce(_apply(tokens, lambda t: _apply(F.transform(t, lambda w: F.xxhash64(w)), from_tokens)), F.array().cast("array<bigint>"))


def _apply(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a one-element array carries it into the lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashes(picked: Column) -> Column:
    """Distinct selected hashes, without positions."""
    return F.array_distinct(F.transform(picked, lambda x: F.shiftright(x, 31)))


def printed(picked: Column) -> Column:
    """The fingerprint as text: ``hash@position`` in hexadecimal, in order of position."""
    return F.array_join(F.transform(picked, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), F.lower(F.hex(F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)) - 1)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``picked``: the selected hashes with positions of ``text``."""
    return docs.withColumn("picked", selected(F.col("text"), k, window))


def with_next(docs: DataFrame, *columns: str) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the document with the next smaller doc_id; the smallest gets the largest.

    Neighbours meet in buckets of a range of ids, so rows move once; a bucket also gets the document that follows its
    last one. At most ``BUCKETS`` ids are broadcast for that. Rows of one doc_id follow each other in the order of their
    texts; null doc_ids come last of all.
    """
    docs = docs.select(F.col("doc_id").cast("long"), *[c for c in docs.columns if c != "doc_id"])
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if not n:
        return docs.withColumn("next", F.struct(*columns))
    if low is None:
        low = high = 0
    width = max(1, -(-(high - low + 2) // max(1, min(n // ROWS, BUCKETS))))
    # null ids sort below every other one
    place = F.coalesce(F.col("doc_id"), F.lit(low - 1))
    bucket = F.floor((place.cast("decimal(20,0)") - F.lit(low - 1)) / F.lit(width)).cast("long")
    docs = docs.withColumn("bucket", bucket)
    tops = docs.groupBy("bucket").agg(F.max(place).alias("top"))
    ring = Window.orderBy(F.desc("bucket"))
    tops = tops.select("top", F.coalesce(F.lag("bucket").over(ring), F.lit(-1).cast("long")).alias("above"))
    last = docs.agg(F.min("bucket")).first()[0]
    tops = tops.select("top", F.when(F.col("above") < 0, F.lit(last)).otherwise(F.col("above")).alias("above"), (F.col("above") < 0).alias("round"))
    ghosts = (docs.withColumn("top", place).join(F.broadcast(tops), "top")
              .select(*[F.col(c) for c in docs.columns if c != "bucket"], F.col("above").alias("bucket"), F.lit(True).alias("ghost")))
    both = docs.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy(F.asc("ghost"), F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return both.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("not ghost").drop("ghost", "bucket")


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per document its fingerprint and that of the text whose second half is replaced by the beginning of the next one.

    The last floor(n_chars / 2) code points give way to as many from the next document (or all of it).
    Null texts are empty. Other columns of the input are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(fingerprints(docs, k, window), "text", "picked")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "picked", F.col("next.picked").alias("next_picked"))
    return out.withColumn("edited_picked", selected(F.col("edited"), k, window))


def fingerprint_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints as text with their likeness to the edited text's and the next document's."""
    own, edited, following = (hashes(F.col(c)) for c in ("picked", "edited_picked", "next_picked"))
    return edited_fingerprints(docs, k, window).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("picked")).alias("fingerprint"), printed(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"))
