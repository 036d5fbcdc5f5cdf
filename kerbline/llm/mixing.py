"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import cut_lineage, word_count
from kerbline.operators import ordered

#: Production weights, repeating over the sources in code point order.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix"
#: A source's rows meet its target in this many places, so that a source with a third of all rows isn't one task's.
SALTS = 64


def random_odds(id_col: str, seed: str = SEED) -> Column:
    """u / (1 - u) of a uniform draw that only depends on the id: 52 bits of its digest."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    u = (drawn + 0.5) / float(1 << 52)
    return u / (1 - u)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target of a table (source, source_size).

    A source's share is its weight times a common level, and at most ``most`` times its size.  Sources reach
    that bound in the order of size per weight, so the level is the first one that the next source doesn't exceed.
    """
    ranked = ordered.scan(
        sizes.withColumn("is_null", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit(""))),
        ["is_null", "name"], sums={"nth": F.lit(1).cast("long")},
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = cut_lineage(ranked.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight")))
    running = ordered.scan(weighed, ["ratio", "nth"], sums={"size_to": F.col("source_size"), "weight_to": F.col("weight")})
    all_size, all_weight = weighed.agg(F.sum("source_size")).scalar(), weighed.agg(F.sum("weight")).scalar()
    level = (all_size - most * (F.col("size_to") - F.col("source_size"))) / (all_weight - (F.col("weight_to") - F.col("weight")))
    fits = running.withColumn("level", level).filter(F.col("level") * F.col("weight") <= most * F.col("source_size"))
    common = fits.agg(F.min_by("level", F.struct("ratio", "nth"))).scalar()
    return weighed.select("source", "source_size", F.least(common * F.col("weight"), most * F.col("source_size").cast("double")).alias("target"))


def _salted_left_join(rows: DataFrame, few: DataFrame, source: str, key: str) -> DataFrame:
    """Rows with what ``few`` says of their source; ``few`` has one row per source."""
    spread = few.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, F.col(source).eqNullSafe(F.col(key)) & (F.col("__salt") == F.col("__place")), "left").drop("__place")


def damped_size(size: Column) -> Column:
    """Binary digits of a size: the measure of the registered mix.  Longer texts are likelier, but only by steps of doubling."""
    return F.length(F.bin(size)).cast("double")


def _levels(grouped: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """source, level: expected copies are the level times the measure, at most ``most``, and add up to the source's target in words.

    ``grouped`` has one row per (source, measure) with its words.  Measures reach the bound from the largest down, so
    the level is the first one that the next measure doesn't exceed.  A source whose target is its bound has none.
    """
    whole = grouped.groupBy("source").agg(F.sum("words").alias("all_words"), F.sum(F.col("words") * F.col("measure")).alias("all_measured"))
    named = grouped.withColumn("is_null", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit("")))
    running = ordered.scan(
        named, [-F.col("measure")], ["is_null", "name"], sums={"words_to": F.col("words"), "measured_to": F.col("words") * F.col("measure")}
    )
    few = whole.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    few = few.select(F.col("source").alias("s"), "target", "all_words", "all_measured")
    rest = F.col("all_measured") - (F.col("measured_to") - F.col("words") * F.col("measure"))
    level = F.when(rest > 0, (F.col("target") - most * (F.col("words_to") - F.col("words"))) / F.nullif(rest, F.lit(0.0)))
    return (
        running.join(few, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("target") < most * F.col("all_words")) & (F.col("measure") > 0))
        .withColumn("level", level).filter(F.col("level") * F.col("measure") <= most)
        .groupBy("source").agg(F.max_by("level", "measure").alias("level"))
    )


def _mix(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], most: int, seed: str, measure: Column | None
) -> DataFrame:
    """The rows of ``docs``, columns named by their place (c0, c1, ...), with __size, __source_size, __target and __copies."""
    at = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    id_col, text_col, source_col = (at[c.lower()] for c in (id_col, text_col, source_col))
    given = F.lit(None) if measure is None else measure
    made = docs.select("*", given.cast("double")).toDF(*at.values(), "__measure")
    made = made.withColumn("__size", word_count(text_col)).withColumn("__measure", F.coalesce("__measure", damped_size(F.col("__size"))))
    made = made.withColumn("__salt", F.pmod(F.xxhash64(id_col, "__size"), F.lit(SALTS)).cast("int"))
    grouped = made.groupBy(F.col(source_col).alias("source"), F.col("__measure").alias("measure")).agg(F.sum("__size").alias("words"))
    grouped = cut_lineage(grouped)
    targets = cut_lineage(source_targets(grouped.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    levels = _levels(grouped, targets, float(most)).select(F.col("source").alias("__l"), F.col("level").alias("__level"))
    targets = targets.join(levels, F.col("source").eqNullSafe(F.col("__l")), "left").select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__level"
    )
    wanted = F.when(F.col("__source_size") == 0, 0.0).when(F.col("__target") >= most * F.col("__source_size"), float(most)).otherwise(
        F.least(F.lit(float(most)), F.coalesce("__level", F.lit(0.0)) * F.col("__measure"))
    )
    rows = (
        _salted_left_join(made, targets, source_col, "__source")
        .withColumn("__wanted", wanted)
        .withColumn("__whole", F.floor("__wanted"))
        .withColumn("__p", F.col("__wanted") - F.col("__whole"))
        .withColumn("__rank", F.when(F.col("__p") > 0, random_odds(id_col, seed) / (F.col("__p") / (1 - F.col("__p")))).otherwise(float("inf")))
    )
    # what the certain copies leave of each source's target
    certain = rows.groupBy(F.col(source_col).alias("__c")).agg(F.sum(F.col("__whole") * F.col("__size")).alias("__certain"))
    certain = cut_lineage(certain)
    rows = _salted_left_join(rows, certain, source_col, "__c").drop("__c")
    null_source = F.col(source_col).isNull().cast("int")
    placed = ordered.scan(
        rows.withColumn("__null", null_source).withColumn("__name", F.coalesce(F.col(source_col), F.lit(""))),
        ["__rank", F.coalesce(F.col(id_col), F.lit(0)), "__size"], ["__null", "__name"], sums={"__upto": F.col("__size")},
    )
    before = F.col("__upto") - F.col("__size")
    left = F.col("__target") - F.col("__certain")
    taken = (F.col("__p") > 0) & (2 * before + F.col("__size") <= 2 * left)
    return placed.select(
        *at.values(), "__size", "__source_size", "__target", (F.col("__whole") + taken.cast("int")).cast("int").alias("__copies")
    )


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED, measure: Column | None = None,
) -> DataFrame:
    """All rows of ``docs`` with __size, __source_size, __target and __copies (whole copies that the mix takes).

    A document's expected copies are its source's level times its ``measure`` (the binary digits of its size unless
    given), at most ``most``; the level is such that the expected words are the source's target.  The whole part is
    certain, and the fraction is the document's inclusion probability.  Documents are ranked by random odds over
    inclusion odds, and a source's documents are taken in this order until their words reach what the certain copies
    left of its target; the last one is taken if that comes nearer.  Draws depend on id and seed only, and sums of
    whole measures are exact, so reruns agree.  The size fixed for a sample is thus its number of words.

    Running sums go over range slices of (source, rank), so a source of any share is spread over all tasks.

    Defined cases: a null text has size 0 and is taken 0 times by size (its copies are whole ones only); null
    sources form one source, the last; sources of size 0 have target 0; a null measure is the size's, one of 0 or less is
    never wanted unless the source's target is its bound; repeated rows are ranked one by one (ties by size); an empty
    table gives no rows; extra columns pass through, whatever their names, but those named like the four that are
    added are replaced by them.
    """
    added = ("__size", "__source_size", "__target", "__copies")
    mix = _mix(docs, id_col, text_col, source_col, weights, most, seed, measure)
    return mix.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in added], *added)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED, measure: Column | None = None,
) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with all their columns whatever their names."""
    mix = _mix(docs, id_col, text_col, source_col, weights, most, seed, measure).filter("__copies > 0")
    return mix.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, length(bin(size))::double m,
    (('0x' || md5('mix:' || doc_id)[1:13])::bigint + 0.5::double) / (1::bigint << 52)::double u from documents
), s as (
  select source, sum(size)::bigint source_size from d group by 1
), w as (
  select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double weight, row_number() over (order by source nulls last) nth from s
), r as (
  select *, source_size / weight ratio, sum(source_size) over () - 3 * (sum(source_size) over (order by source_size / weight, nth) - source_size) rest_size,
    sum(weight) over () - (sum(weight) over (order by source_size / weight, nth) - weight) rest_weight from w
), l as (
  select min_by(rest_size / rest_weight, (ratio, nth)) common from r where rest_size / rest_weight * weight <= 3 * source_size
), t as (
  select source, source_size, least((select common from l) * weight, 3.0::double * source_size)::double target from w
), g as (
  select source, m, sum(size) words from d group by 1, 2
), h as (
  select source, m, words, sum(words) over a - words words_above, sum(words * m) over (partition by source) - (sum(words * m) over a - words * m) rest_measured
  from g window a as (partition by source order by m desc)
), v as (
  select h.source, max_by((target - 3.0::double * words_above) / rest_measured, m) level from h join t on h.source is not distinct from t.source
  where target < 3.0::double * source_size and rest_measured > 0 and (target - 3.0::double * words_above) / rest_measured * m <= 3 group by 1
), e as (
  select d.doc_id, d.size, t.source, t.source_size, t.target, u,
    case when source_size = 0 then 0 when target >= 3.0::double * source_size then 3 else least(3.0::double, coalesce(level, 0) * m) end::double wanted
  from d join t on d.source is not distinct from t.source left join v on d.source is not distinct from v.source
), p as (
  select *, floor(wanted) whole, wanted - floor(wanted) p from e
), k as (
  select *, sum(size) over (partition by source order by case when p > 0 then u / (1 - u) / (p / (1 - p)) else 'inf'::double end, doc_id, size) - size before,
    target - sum(whole * size) over (partition by source) rest from p
)
select doc_id, size::bigint size, source_size, target, ((whole + case when p > 0 and 2 * before + size <= 2 * rest then 1 else 0 end) * size)::bigint taken from k
"""
