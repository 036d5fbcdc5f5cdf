"""How text filters interact: per-part posting lists of failing rows, merged for every set of filters that ran before."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import cut_plan

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 100, 80, 10
#: The capitals that C counts and the signs that D looks for.
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Rows at most of a range of ids: the length that bounds a posting list.
RANGE_ROWS = 1 << 16
LISTS = [*FILTERS, "good", "toxic"]
SIZES = ["n", "failing", "removed", "gone", "good", "toxic"]


def failing(raw: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    found = raw.split()  # bytes split at the six ASCII spaces, and at nothing else
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(found) < LEAST_WORDS)
        | (100 * len(set(found)) < DISTINCT_SHARE * len(found)) << 1
        | (100 * capitals > CAPITAL_SHARE * code_points) << 2
        | (len(raw.translate(None, SIGNS)) < len(raw)) << 3
    )


def flagged(docs: DataFrame) -> DataFrame:
    """id, part, mask (bits of A to D), digest (SHA-256 of the text) and tie (place in its task) of every row."""
    kind = docs.schema["id"].dataType.simpleString()

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            masks, digests = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                raw = text.encode()
                masks.append(failing(raw, len(text)))
                digests.append(hashlib.sha256(raw).digest())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary()), pa.array(np.arange(seen, seen + n))],
                names=["id", "part", "mask", "digest", "tie"],
            )
            seen += n
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(flag, f"id {kind}, part string, mask int, digest binary, tie long")


def marked(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask and tie of every row, the mask with E (a smaller id has the text), good and toxic as well.

    Digests and labels are aggregated before they are shuffled, and joined without hints: a text or an id with many
    rows is split at run time.
    """
    own = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")
    )
    rows = cut_plan(flagged(own))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))

    def bit(said: Column, at: int) -> Column:
        return F.when(said, F.lit(1 << at)).otherwise(0)

    mask = F.col("mask").bitwiseOR(bit(F.col("first") < F.col("id"), 4)).bitwiseOR(bit(F.col("good"), 5)).bitwiseOR(bit(F.col("toxic"), 6))
    return rows.join(first, "digest", "left").join(said, "id", "left").select("part", "id", "tie", mask.alias("mask"))


def postings(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per part and range of ids: part, first_id, last_id, n, and per filter the sorted list of failing rows.

    Rows are range-sorted by (part, id, tie), so a part of any size is many ranges of at most ``range_rows`` rows; a
    row's number in its range stands for its id, so repeated and null ids are rows of their own.
    """
    kind = rows.schema["id"].dataType.simpleString()
    lists = ", ".join(f"`{c}` array<int>" for c in LISTS)

    def close(part: str, ids: pa.ChunkedArray | pa.Array, masks: np.ndarray) -> pa.RecordBatch:
        found = [pa.array([np.flatnonzero(masks >> b & 1).astype(np.int32)], pa.list_(pa.int32())) for b in range(len(LISTS))]
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), ids.slice(0, 1), ids.slice(len(masks) - 1, 1), pa.array([len(masks)], pa.int64()), *found],
            names=["part", "first_id", "last_id", "n", *LISTS],
        )

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column("id") for b in held])
            return close(part, ids, np.concatenate([b.column("mask").to_numpy() for b in held]))

        for batch in batches:
            own = batch.column("part").dictionary_encode()
            code = own.indices.to_numpy()
            cuts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)] if len(code) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                name = own.dictionary[int(code[a])].as_py()
                while a < b:
                    if size and (name != part or size == range_rows):
                        yield flush()
                        held, size = [], 0
                    part, to = name, min(b, a + range_rows - size)
                    held.append(batch.slice(a, to - a))
                    size, a = size + to - a, to
        if size:
            yield flush()

    ordered = rows.repartitionByRange("part", "id", "tie").sortWithinPartitions("part", "id", "tie")
    return ordered.select("part", "id", "mask").mapInArrow(post, f"part string, first_id {kind}, last_id {kind}, n long, {lists}")


def _gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each entry of the shorter list stands in the longer one, and whether it is there: one search each, no full pass."""
    at = np.searchsorted(many, few)
    return at, many[np.minimum(at, len(many) - 1)] == few if len(many) else np.zeros(len(few), bool)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists: shorter ones gallop into the longest."""
    lists = sorted(lists, key=len, reverse=True)
    out = lists[0] if lists else np.zeros(0, np.int32)
    for own in lists[1:]:
        at, there = _gallop(own, out)
        out = np.insert(out, at[~there], own[~there])
    return out


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted difference: the shorter list gallops into the longer."""
    if len(a) <= len(b):
        return a[~_gallop(a, b)[1]]
    at, there = _gallop(b, a)
    return np.delete(a, at[there])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries two sorted lists share."""
    return int(_gallop(a, b)[1].sum() if len(a) <= len(b) else _gallop(b, a)[1].sum())


def set_sizes(lists: DataFrame) -> DataFrame:
    """Per part, set of filters that ran before (bits) and next filter: n rows, failing, removed, gone after it, good and toxic rows removed.

    Each range merges its lists for the 16 sets that lack the filter; only sizes leave the range.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, counts = [], []
            for r in range(batch.num_rows):
                own = [np.asarray(batch.column(c)[r].values) for c in LISTS]
                fails, good, toxic = own[:5], own[5], own[6]
                gone = {0: np.zeros(0, np.int32)}
                for before in range(1 << 5):
                    top = before.bit_length() - 1
                    if before:
                        gone[before] = union([gone[before ^ 1 << top], fails[top]])
                    for f in range(5):
                        if not before >> f & 1:
                            removed = difference(fails[f], gone[before])
                            parts.append(batch.column("part")[r].as_py())
                            counts.append((before, f, batch.column("n")[r].as_py(), len(fails[f]), len(removed), len(gone[before]) + len(removed), common(removed, good), common(removed, toxic)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(8)]],
                names=["part", "before", "filter", *SIZES],
            )

    sized = lists.mapInArrow(merge, "part string, before long, filter long, " + ", ".join(f"{c} long" for c in SIZES))
    return sized.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in SIZES])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The texts are scanned once.  Failing rows are posting lists per part, filter and range of ids; unions of the
    filters that ran before and differences with the next one are galloping merges inside a range, and only their
    sizes are summed, 80 numbers a part.  All 120 orders are read off these sums.

    Defined cases: a null text is an empty one and a null part the empty string; repeated rows count each, and a
    row is a copy (E) of smaller ids only; a null id has no smaller and no larger one and no label; a label given
    twice counts once; an empty table gives no rows; other columns are ignored.
    """
    sizes = set_sizes(postings(marked(docs, labels, id_col, text_col, part_col)))
    at = (F.col("before") * 5 + F.col("filter")).cast("int")
    per_part = sizes.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(at, F.struct(*SIZES)))).alias("of")
    )  # at most 80 entries
    steps = []
    for order in itertools.permutations(range(5)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append(f"('{name}', {step}, {f}, {before})")
            before |= 1 << f
    spark = docs.sparkSession
    plan = spark.sql(f"select array_agg(struct(*)) plan from values {', '.join(steps)} as t(filter_order, step, filter, before)").scalar()
    rows = per_part.select("part", "of", F.explode(plan).alias("p")).select("part", "of", "p.*")

    def said(before: Column, f: Column) -> Column:
        return F.col("of")[before * 5 + f]

    own, f, before = said(F.col("before"), F.col("filter")), F.col("filter"), F.col("before")
    weight = [math.factorial(m.bit_count()) * math.factorial(4 - m.bit_count()) if m.bit_count() < 5 else 0 for m in range(32)]
    # a set that holds the filter itself has no entry
    shapley = sum((F.coalesce(said(F.lit(m), f)["removed"], F.lit(0)) * weight[m] for m in range(31)), F.lit(0))
    all_others = F.lit(31) - F.pow(F.lit(2), f).cast("int")
    return rows.select(
        "part", "filter_order", "step", (own["n"] - own["gone"]).alias("kept"), own["removed"].alias("removed"),
        (own["failing"] - own["removed"]).alias("redundant"), said(all_others, f)["removed"].alias("unique_fails"),
        own["good"].alias("good_lost"), own["toxic"].alias("toxic_lost"), shapley.cast("long").alias("shapley"),
    )


SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), f as (
  select part,
    [len(w) < 100, 100 * list_unique(w) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) over (partition by t) < doc_id, false)] fails,
    exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1) good,
    exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1) toxic
  from d
), o as (
  select a.x || b.x || c.x || e.x || g.x filter_order from (values ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) b(x),
    (values ('A'), ('B'), ('C'), ('D'), ('E')) c(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) e(x), (values ('A'), ('B'), ('C'), ('D'), ('E')) g(x)
  where len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5
), m as (
  select part, fails, good, toxic, count(*) n from f group by all
), s as (
  select filter_order, unnest(range(1, 6)) step from o
), x as (
  select part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) own,
    fails[ascii(substr(filter_order, step, 1)) - 64] fails,
    list_bool_or([false] || [fails[ascii(substr(filter_order, i, 1)) - 64] for i in range(1, step)]) gone,
    list_bool_or([fails[ascii(substr(filter_order, i, 1)) - 64] for i in range(1, 6) if i <> step]) elsewhere
  from m, s
), r as (
  select part, filter_order, step, own, sum(case when not gone and not fails then n else 0 end)::bigint kept,
    sum(case when fails and not gone then n else 0 end)::bigint removed, sum(case when fails and gone then n else 0 end)::bigint redundant,
    sum(case when fails and not elsewhere then n else 0 end)::bigint unique_fails,
    sum(case when fails and not gone and good then n else 0 end)::bigint good_lost, sum(case when fails and not gone and toxic then n else 0 end)::bigint toxic_lost
  from x group by all
)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint shapley
from r
"""
