"""Canonical exact digests of documents [DataFrame functions only].

A text's canonical form is its NFKC normal form, case-folded, normalised again, with every run of
white space folded to one space and none at its ends. Its fingerprint is two XXH64 sums of that
form under different seeds (128 bits). Documents are grouped by the sums, and within a bucket by
the canonical bytes themselves: should different forms ever share a bucket, all but the first
form's fingerprints get a number appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash

#: Rows aimed at in a bucket of neighbouring ids; parts that ids, and then each part, are cut into.
BUCKET_ROWS, PARTS = 4096, 256


def canonical(text: Column) -> Column:
    """The canonical form; null is taken as empty."""
    call = lambda cls, method, x: F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))
    nfkc = lambda x: call("text.Normalizer", "compose", x)
    folded = nfkc(call("lang.UCharacter", "foldCase", nfkc(F.coalesce(text.cast("string"), F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", " "))


def digests(form: Column) -> tuple[Column, Column]:
    return F.xxhash64(form), F.xxhash64(F.lit("second seed"), form)


def as_text(a: str | Column, b: str | Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (a, b)])


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """kid, th tell documents apart; a null doc_id is one beneath all others."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), body.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("kid"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text"
    )


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kid, th, n_chars, f1, f2) of every row, stashed: a scan without a shuffle."""
    rows = _keyed(docs, text).withColumn("form", canonical(F.col("text")))
    f1, f2 = digests(F.col("form"))
    return stash(rows.select("doc_id", "kid", "th", F.length("text").cast("long").alias("n_chars"), f1.alias("f1"), f2.alias("f2")), "digests")


def collisions(docs: DataFrame, prints: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame] | None:
    """(kid, th, number): the documents whose canonical bytes differ from those of the first form
    in their bucket, and (f1, f2, form, number) of these forms; None if there are none. Only buckets
    of several documents are compared."""
    keys = prints.select("kid", "th", "f1", "f2").distinct()
    many = keys.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    members = _keyed(docs, text).drop("doc_id").join(keys.join(many, ["f1", "f2"], "left_semi"), ["kid", "th"]).withColumn("form", canonical(F.col("text")))
    forms = stash(members.groupBy("f1", "f2", "form").agg(F.min("kid").alias("low")).groupBy("f1", "f2").agg(F.count("*").alias("forms")).where("forms > 1"), "shared")
    if forms.isEmpty():
        return None
    clash = members.join(forms.select("f1", "f2"), ["f1", "f2"], "left_semi")
    lows = clash.groupBy("f1", "f2", "form").agg(F.min("kid").alias("low"))
    lows = lows.withColumn("number", F.row_number().over(Window.partitionBy("f1", "f2").orderBy("low", "form")) - 1)
    lows = stash(lows.where("number > 0").select("f1", "f2", "form", "number"), "forms")
    return clash.join(lows, ["f1", "f2", "form"]).select("kid", "th", "number").distinct(), lows


def neighbours(prints: DataFrame) -> DataFrame:
    """For each different (kid, th): next_kid, next_th, next_f1, next_f2 of the next document in
    descending order of id, the first after the last. One bucket of ids is one window group: ids are
    cut at percentiles, and where there are many, each part at percentiles of its own, so buckets
    are even however ids are spread; null ids are cut by th."""
    keys = prints.select("kid", "th", "n_chars", "f1", "f2").distinct()
    null = F.col("kid") == -(1 << 63)
    stats = keys.agg(F.count("*"), F.count(F.when(null, 1)), F.percentile_approx(F.when(~null, F.col("kid")), [i / PARTS for i in range(PARTS + 1)], 2000)).first()
    cuts = sorted(set(stats[2] or [0]))
    below = lambda array: F.expr(f"cast(size(filter({array}, c -> c <= kid)) as long)")
    keys = keys.withColumn("q", below(f"array({', '.join(f'{c}L' for c in cuts)})"))
    within = max(1, min(PARTS, -(-stats[0] // (BUCKET_ROWS * len(cuts)))))
    sub = F.lit(0).cast("long")
    if within > 1:  # PARTS + 2 rows of PARTS numbers at most
        finer = keys.where(~null).groupBy("q").agg(F.percentile_approx("kid", [i / within for i in range(1, within)], 2000).alias("finer"))
        keys = keys.join(F.broadcast(finer), "q", "left")
        sub = F.coalesce(below("coalesce(finer, array())"), F.lit(0).cast("long"))
    nulls = max(1, -(-stats[1] // BUCKET_ROWS))
    by_text = -1 - F.least(F.lit(nulls - 1), F.floor((F.col("th").cast("double") / float(1 << 64) + 0.5) * nulls)).cast("long")
    keys = keys.withColumn("bucket", F.when(null, by_text).otherwise(F.col("q") * (PARTS + 1) + sub)).drop("q", "finer")
    order = [F.desc("kid"), F.asc("th")]
    then = F.struct("kid", "th", "f1", "f2")
    keys = keys.withColumn("then", F.lead(then).over(Window.partitionBy("bucket").orderBy(*order)))
    # the last of each bucket is followed by the first of the next lower bucket that has any
    tops = keys.groupBy("bucket").agg(F.max(F.struct("kid", (-1 - F.col("th")).alias("back"), "f1", "f2")).alias("top"))
    tops = tops.select("bucket", F.struct("top.kid", (-1 - F.col("top.back")).alias("th"), "top.f1", "top.f2").alias("top"))
    down = Window.orderBy(F.desc("bucket"))
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("bucket", F.coalesce(F.lead("top").over(down), F.first("top").over(everything)).alias("below"))
    out = keys.join(tops, "bucket").withColumn("then", F.coalesce("then", "below"))
    return out.select("kid", "th", "n_chars", *[F.col(f"then.{c}").alias(f"next_{c}") for c in ("kid", "th", "f1", "f2")])


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, group_id (smallest doc_id of the canonical text) and group_size.

    The edited text is the text with its last third replaced by the next document's beginning.
    Null and empty texts count as empty; a null id is beneath all others; rows alike in id and
    text are one document and get equal results; different texts under one id are neighbours; a
    table of one document is its own neighbour; an empty table gives no rows; other columns are
    not looked at. Likeness of digests is 1 where they are equal, else 0."""
    prints = fingerprints(docs, text)
    odd = collisions(docs, prints, text)
    plain = as_text("f1", "f2")
    name = prints.select("kid", "th", "doc_id", "f1", "f2")
    if odd is None:
        name = name.withColumn("fingerprint", plain)
    else:
        name = name.join(odd[0], ["kid", "th"], "left").withColumn("fingerprint", F.concat(plain, F.coalesce(F.concat(F.lit("-"), F.col("number").cast("string")), F.lit(""))))
    groups = name.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    name = name.select("kid", "th", "fingerprint").distinct().join(groups, "fingerprint")
    near = neighbours(prints)
    facts = near.join(name, ["kid", "th"])
    if odd is None:
        facts = facts.withColumn("near_next", (F.col("fingerprint") == as_text("next_f1", "next_f2")).cast("double"))
    else:
        then = name.select(F.col("kid").alias("next_kid"), F.col("th").alias("next_th"), F.col("fingerprint").alias("then"))
        facts = facts.join(then, ["next_kid", "next_th"]).withColumn("near_next", (F.col("fingerprint") == F.col("then")).cast("double"))
    facts = facts.join(prints.select("kid", "th", "doc_id").distinct(), ["kid", "th"])
    facts = stash(facts.select("doc_id", "kid", "th", "n_chars", "next_kid", "next_th", "fingerprint", "near_next", "group_id", "group_size"), "facts")

    rows = _keyed(docs, text).drop("doc_id")  # shuffled once, for both joins below
    # each document is the next one of one other: what that one takes from it, a third at most
    before = facts.where("n_chars >= 3").select(F.col("kid").alias("to_kid"), F.col("th").alias("to_th"), F.col("next_kid").alias("kid"), F.col("next_th").alias("th"), "n_chars")
    taken = rows.join(before, ["kid", "th"]).withColumn("head", F.expr("substring(text, 1, cast(n_chars div 3 as int))"))
    taken = taken.select("kid", "th", "to_kid", "to_th", "head").dropDuplicates(["kid", "th"])  # rows that are repeated
    taken = taken.select(F.col("to_kid").alias("kid"), F.col("to_th").alias("th"), "head")
    whole = rows.join(facts.drop("next_kid", "next_th"), ["kid", "th"]).join(taken, ["kid", "th"], "left")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.coalesce("head", F.lit("")))
    whole = whole.withColumn("edited", edited).withColumn("form", canonical(F.col("edited")))
    f1, f2 = digests(F.col("form"))
    changed = as_text(f1, f2)
    if odd is not None:  # an edited text may be one of the forms that got a number
        whole = whole.withColumns({"f1": f1, "f2": f2}).join(odd[1], ["f1", "f2", "form"], "left")
        changed = F.concat(as_text("f1", "f2"), F.coalesce(F.concat(F.lit("-"), F.col("number").cast("string")), F.lit("")))
    out = whole.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", changed.alias("edited_fingerprint"), "near_next", "group_id", "group_size")
    same = (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same.alias("near_edited"), "near_next", "group_id", "group_size")
