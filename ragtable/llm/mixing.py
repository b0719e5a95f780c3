"""Mixing sources to target weights along a time-varying curriculum (operator 3).

DataFrame and SQL functions only. Sources by code point order (null last) get
the weights in turn; all words are shared by weight, no source above ``cap``
times its own words, the excess reshared by weight until none is above. The
shares have a closed form: in order of cap/weight the capped sources come
first, and what they leave is divided by weight.

Curriculum: source s enters training at the rate D_s * f_s(t), t in [0, 1],
with f_s(t) = 1 + slope_s * (2t - 1); integrated, its first t takes
D_s * F_s(t) words, F_s(t) = t + slope_s * (t*t - t). A source's documents are
put in a fixed pseudo-random order and read in passes until D_s words are
demanded; the last pass stops inside a document where need be. The pass over a
document that begins at word x of the demand is at position F_s^-1(x / D_s),
and ``training_order`` range-sorts the passes by it.

A source may hold any share of all rows: running sums have two levels (bucket
by the order key's leading digits, then rows of a bucket), so no window holds a
whole source. Defined results: null or wordless text has size 0 and is never
taken; a null source is a source of its own; equal rows are interchangeable;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
CAP = 3
ROWS_PER_BUCKET = 2000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, ord): size in words, ord the fixed pseudo-random order key."""
    return docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("ord"))


def shares(totals: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> + target, demand (whole words), slope. One row per source, so one window over them is small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("k", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % len(values) + 1).cast("int"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = ranked.select("source", "source_size", "k", pick(weights).cast("long").alias("w"), pick(slopes).cast("double").alias("slope"),
                           (F.col("source_size") * cap).alias("most"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("most") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    left = (ranked.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
            .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
            .withColumn("capped", big("most") * big("rest_w") <= big("rest") * big("w")))
    # the first source that is not capped has what all others of its kind share
    rate = F.max(F.when(~F.col("capped"), F.struct(-F.col("most") / F.col("w"), -F.col("k"), F.col("rest").alias("rest"), F.col("rest_w").alias("rest_w")))).over(every)
    out = left.withColumn("rate", rate).withColumn(
        "target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("rate.rest").cast("double") / F.col("rate.rest_w") * F.col("w")))
    return out.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("demand"), "slope")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, cap: int = CAP) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, passes array<struct<epoch, words, position>> for every row."""
    rows = cut_lineage(sized(docs))
    digits, room = 1, ROWS_PER_BUCKET * 16
    n = rows.count()
    while n > room:
        digits, room = digits + 1, room * 16
    keyed = rows.withColumn("bucket", F.substring("ord", 1, digits)).withColumn("src", F.to_json(F.struct("source")))
    parts = keyed.groupBy("src", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    share = shares(parts.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).drop("src"), weights, slopes, cap)
    share = share.withColumn("src", F.to_json(F.struct("source"))).drop("source")
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (parts.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .select("src", "bucket", "base").join(share, "src"))
    inside = Window.partitionBy("src", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = keyed.withColumn("upto", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["src", "bucket"])
    at = (at.withColumn("start", F.col("base") + F.col("upto"))
          .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("demand") / F.col("source_size"))).otherwise(0).cast("long"))
          .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - F.col("whole") * F.col("source_size") - F.col("start")))))

    def one(e):
        u = (F.col("start") + e * F.col("source_size")).cast("double") / F.col("demand")
        b = F.lit(1.0) - F.col("slope")
        return F.struct(e.alias("epoch"), F.when(e < F.col("whole"), F.col("size")).otherwise(F.col("rest")).alias("words"),
                        F.round(u * 2 / (b + F.sqrt(b * b + F.col("slope") * u * 4)), 9).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), one), lambda p: p["words"] > 0)
    return at.select("doc_id", "size", "source", "source_size", "target",
                     (F.col("whole") * F.col("size") + F.col("rest")).cast("long").alias("taken"), passes.alias("passes"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per pass over a document (doc_id, source, epoch, words, position), range-sorted by training position."""
    return (mixed.select("doc_id", "source", F.explode("passes").alias("p")).select("doc_id", "source", "p.epoch", "p.words", "p.position")
            .orderBy("position", "source", "doc_id", "epoch"))


def document_order(mixed: DataFrame) -> DataFrame:
    """One row per document (doc_id, source, size, source_size, target, taken, position of its first pass), range-sorted by position; untaken ones last."""
    return (mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.try_element_at("passes", F.lit(1))["position"].alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))
