"""Mixing sources to target weights: native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclabel.llm.common import WORD, fresh
from doclabel.operators.ordering import with_dense_id
from doclabel.staging import stage

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of ``sources`` (source, source_size): shares by weight, none above ``cap`` times its source.

    Weights repeat along the sources in code-point order, null last. The level
    per unit of weight rises until no source is above its cap: each round is one
    aggregate of one row over the sources, however many there are.
    """
    ranked = with_dense_id(sources, F.asc_nulls_last("source"), name="place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    ranked = stage(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("cap")), "sources")
    first = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, level, full = share * (first["size"] or 0), 0.0, -1
    if first["weight"]:
        level = total / first["weight"]
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        got = ranked.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("open"),
        ).first()
        if got["n"] == full or not got["open"]:
            break
        full, level = got["n"], (total - got["taken"]) / got["open"]
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """How often the mix takes every document: doc_id, source, size, source_size, target, copies, taken.

    A document's size is its number of words; its source's repetition rate is
    target / source_size. It is taken floor(rate) times, and once more if a
    number drawn from md5(doc_id:seed) is below the fraction.

    Null text: size 0. Null source: a source of its own, ranked last. Null
    doc_id: the draw uses the text. Rows that repeat a doc_id share its draw.
    Sources without words have target 0 and give nothing. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary"))))
    draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), draw.alias("draw")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("bigint")
    # The source table is joined map-side only if its true file size allows it (Spark's own rule).
    return sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan takes it, with all its columns and a copy number.

    The added column is ``copy`` (a leading underscore if the table has one).
    Targets and draws as in ``mix_plan``; nothing but the source table is joined.

    Null texts have size 0; null sources, null and repeated ids as in
    ``mix_plan``. Empty tables give empty results. Other columns pass unchanged,
    whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    seed = options.pop("seed", SEED)
    plan = mix_plan(docs, seed=seed, **options).groupBy("source").agg(F.max("source_size").alias("z"), F.max("target").alias("t"))
    on, found, z, t = (fresh(docs, f"_mix_{c}") for c in ("on", "source", "z", "t"))
    rates = stage(plan, "rates").select(F.col("source").alias(found), F.col("z").alias(z), F.col("t").alias(t))
    rows = docs.withColumn(on, F.col("source").cast("string"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary"))))
    draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    rate = F.when(F.col(z) > 0, F.col(t) / F.col(z)).otherwise(0.0)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("int")
    joined = rows.join(rates, F.col(on).eqNullSafe(F.col(found)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias(fresh(docs, "copy")))
