"""Personal data and the terms that give it away, in Spark expressions only.

Pattern finds are protected entities. A term of the documents of an entity discloses it as far as it narrows it down:
PMI(term; entity) = log2(P(entity | term) / P(entity)), over documents, against the entity's information content
-log2 P(entity) (C-sanitisation, Sánchez and Batet 2016). The ratio is 1 where the term occurs with the entity only.
Terms from ``generalise`` up become a class name in the documents that hold the entity, from ``remove`` up they go.
Evidence needs two documents of different words: copies of one document prove nothing. Where fewer than ``support`` prove it,
P(entity | term) is smoothed by one document against it. Entities are also pooled by what they share (mail domain or local
part, network, issuer, number range): a pool is an entity like others, so one that occurs once is reached by its pools. Terms are runs of letters and
digits of any length; the documents are counted whole, however far the term is from the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonemill.llm.store import stored

KINDS = ("email", "ip", "card", "phone")
# A match starts where a run of its characters starts or where the last match ended; possessive groups never go back,
# which is the same as greedy here because nothing follows them, and keeps long runs linear and off the stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
SPAN = "struct<kind:string,from:int,to:int,value:string>"
ISSUER = 6  # leading digits of a card that name its issuer
TOGETHER = 256  # matches whose list grows together
LINE = 4  # last digits of a phone number, without which it is a number range
LEAST = 2  # documents of different words without which nothing is told from chance
EVIDENCE = 6.6  # bits: by chance, fewer than one in a hundred terms stands in documents of the entity only


def _apply(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column, start: Column, step, empty: Column) -> Column:
    """``aggregate`` over a list with a growing result (``at``, ``out``): ``step`` gives the next ``at`` and a list to add.

    A list is copied whenever it grows, so results grow within blocks of ``TOGETHER`` items and blocks are joined at the end:
    linear in the number of items for any text that fits into a row.
    """
    def inner(s: Column, x: Column) -> Column:
        at, more = step(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], more).alias("out"))

    def outer(s: Column, b: Column) -> Column:
        part = F.slice(items, b * TOGETHER + 1, F.lit(TOGETHER))
        return F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("out")), inner, lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / TOGETHER).cast("int"))
    return F.aggregate(blocks, F.struct(start.alias("at"), F.array(empty).alias("out")), outer)


def found(text: Column, pattern: str, wanted=lambda v: F.lit(True)) -> Column:
    """All matches that are ``wanted``, with code-point positions: what lies between them, by ``split``, gives where they are."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    empty = F.array().cast("array<struct<from:int,to:int,value:string>>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        span = F.array(F.struct((at + x["g"]).alias("from"), (at + x["g"] + x["n"]).alias("to"), x["v"].alias("value")))
        return at + x["g"] + F.coalesce(x["n"], F.lit(0)), F.when(x["v"].isNull() | ~wanted(x["v"]), empty).otherwise(span)

    def placed(pair: Column) -> Column:
        zipped = F.zip_with(pair["g"], pair["h"], lambda a, b: F.struct(a.alias("g"), F.length(b).alias("n"), b.alias("v")))
        return F.when(F.size(pair["h"]) > 0, _apply(zipped, lambda z: F.flatten(_folded(z, F.lit(0), step, empty)["out"])))
    return F.coalesce(_apply(F.struct(hits.alias("h"), gaps.alias("g")), placed), empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; the digit sum is a multiple of ten."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: _apply(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.substring(q, 1, 3).cast("int") <= 255)))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _labelled(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda s: F.struct(F.lit(kind).alias("kind"), s["from"].alias("from"), s["to"].alias("to"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, in the order of ``KINDS``, then of their place; null is empty."""
    text = F.coalesce(text, F.lit(""))
    cheap = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.contains(text, F.lit("."))}
    parts = []
    for kind in KINDS:
        spans = _labelled(found(text, PATTERNS[kind], lambda v, kind=kind: _valid(kind, v)), kind)
        ahead = cheap.get(kind, F.lit(True)) & (F.lit(True) if kind == "email" else text.rlike("[0-9]"))
        parts.append(F.when(ahead, spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*parts)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _entities(base: Column) -> Column:
    """Distinct entities of a document's spans and their pools, in order."""
    def named(s: Column) -> Column:
        value = F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
        pools = (F.when(s["kind"] == "email", F.array(F.regexp_extract(value, "@.*", 0), F.regexp_extract(value, "^[^@]*@", 0)))
                 .when(s["kind"] == "ip", F.array(F.regexp_extract(value, r"^[0-9]+\.[0-9]+\.[0-9]+\.", 0)))
                 .when(s["kind"] == "card", F.array(F.substring(value, 1, ISSUER)))
                 .otherwise(F.array(F.regexp_extract(value, f"^(.*).{{{LINE}}}$", 1))))
        return F.concat(F.array(F.concat_ws(":", s["kind"], value)), F.transform(pools, lambda v: F.concat_ws("~", s["kind"], v)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(base, named))))


def disclosing_terms(docs: DataFrame, hits: DataFrame, support: int, generalise: float) -> DataFrame:
    """(group, term, ratio): the terms that disclose an entity of the group, by co-occurrence in whole documents.

    ``hits`` has the documents with spans; those of the same words and entities (copies) are one ``group`` and one piece of evidence.
    """
    total = float(max(docs.count(), 1))
    groups = stored(hits.groupBy("group").agg(F.count("*").alias("copies"), F.first(_entities(F.col("base"))).alias("entities"), F.first(_terms(F.col("text"))).alias("terms")), "groups")
    holders = groups.select("group", "copies", F.explode("entities").alias("entity"))
    p_e = F.col("n_e") / F.lit(total)
    frequent = (holders.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("groups")).where(F.col("groups") >= LEAST)
                .select("entity", "n_e", p_e.alias("p_e")).where(F.col("p_e") < 1))
    spread = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= LEAST)
    words = groups.select("group", F.explode("terms").alias("term")).join(spread, "term")
    # P(entity | term) is at most n_e / n_t: a term too common for the threshold makes no pair
    reach = F.col("n_e") / F.col("n_t") >= F.pow("p_e", F.lit(1.0 - generalise)) * (1 - 1e-9)
    holders = holders.join(frequent, "entity")
    pairs = stored(holders.join(words, (holders["group"] == words["group"]) & reach).select(holders["group"], "copies", "entity", "n_e", "p_e", "term", "n_t"), "pairs")
    told = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("groups"), F.first("n_t").alias("n_t"), F.first("p_e").alias("p_e"))
    bits = -F.log2("p_e")
    against = F.when(F.col("groups") < support, 1).otherwise(0)
    ratio = F.log2(F.col("n_te") / (F.col("n_t") + against) / F.col("p_e")) / bits
    told = told.where((F.col("groups") >= LEAST) & (F.col("groups") * bits >= EVIDENCE)).select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= generalise)
    return pairs.join(told, ["entity", "term"]).groupBy("group", "term").agg(F.max("ratio").alias("ratio"))


def _marked(docs: DataFrame, support: int = 3, generalise: float = 0.85, remove: float = 0.95) -> DataFrame:
    """Rows as a struct ``doc``, with ``base`` (pattern spans) and ``extra`` (terms to be generalised or removed)."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc", "text", base_spans(F.col("text")).alias("base"))
    none = F.array().cast(f"array<{SPAN}>")
    clean = rows.where(F.size("base") == 0).select("doc", "base", none.alias("extra"))
    group = F.xxhash64(F.sort_array(_terms(F.col("text"))), _entities(F.col("base")))
    hits = stored(rows.where(F.size("base") > 0).withColumn("group", group), "personal")
    by_doc = disclosing_terms(rows, hits, support, generalise).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("terms"))
    ratio = lambda w: F.try_element_at(F.col("terms"), F.lower(w["value"]))
    words = found(F.col("text"), WORD, lambda v: F.try_element_at(F.col("terms"), F.lower(v)).isNotNull())
    free = lambda w: ~F.exists("base", lambda b: (b["from"] < w["to"]) & (w["from"] < b["to"]))
    extra = F.transform(F.filter(words, free), lambda w: F.struct(
        F.when(ratio(w) >= remove, "removed").otherwise("term").alias("kind"), w["from"].alias("from"), w["to"].alias("to"), w["value"].alias("value")))
    extra = F.when(F.col("terms").isNull(), none).otherwise(F.array_sort(extra))
    marked = hits.join(by_doc, "group", "left").select("doc", "base", extra.alias("extra"))
    return clean.unionByName(marked)


def spans(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``base_spans`` (patterns) and ``extra_spans`` (disclosing terms), in code points, end exclusive.

    Options are ``support``, ``generalise`` and ``remove``. Kinds of extra spans are ``term`` and ``removed``; those that
    touch a base span are left out. Null texts are empty and have no spans; repeated rows keep their number; other
    columns stay as they are, but for columns with the two new names, which are replaced.
    """
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("base_spans", "extra_spans")]
    return _marked(docs, **options).select(*kept, F.col("base").alias("base_spans"), F.col("extra").alias("extra_spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data replaced by ``<kind>``, disclosing terms by ``<term>`` or nothing. Same columns.

    ``n_chars`` follows the new text. A null text stays null.
    """
    whole = F.col("doc").getField("text")
    marks = F.array_sort(F.concat(*[F.transform(c, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind"))) for c in ("base", "extra")]))

    def replaced(chars: Column) -> Column:
        def step(at: Column, m: Column) -> tuple[Column, Column]:
            shown = F.when(m["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("<"), m["kind"], F.lit(">")))
            ahead = F.array(F.array_join(F.slice(chars, at + 1, F.greatest(m["from"] - at, F.lit(0))), ""), shown)
            return F.greatest(at, m["to"]), F.when(m["from"] >= at, ahead).otherwise(none)
        none = F.array().cast("array<string>")
        done = _folded(marks, F.lit(0), step, none)
        return _apply(done, lambda s: F.concat(F.array_join(F.flatten(s["out"]), ""), F.array_join(F.slice(chars, s["at"] + 1, F.size(chars)), "")))
    # by characters: cutting a long string at a place reads it from the beginning each time
    text = F.when(F.size(marks) > 0, _apply(F.split(whole, ""), replaced)).otherwise(whole)
    out = _marked(docs, **options).select("doc", text.alias("clean"))
    return out.select([F.col("clean").alias(c) if c == "text" else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts by kind, a digest of the pattern spans and all spans as text, per document."""
    show = lambda c: F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string")))
    base = show(F.col("base_spans"))
    def of(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans(docs.select("doc_id", "text"), **options).select(
        "doc_id", *[of(k) for k in KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, show(F.array_sort("extra_spans"))), ",").alias("spans"))
