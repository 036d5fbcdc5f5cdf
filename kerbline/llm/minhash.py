"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm import words
from kerbline.llm.common import cut_plan
from kerbline.llm.components import connected_components
from kerbline.llm.words import mix64

SHINGLE = 5
#: At similarity 0.75, a pair meets in none of 50 bands of 6 bins with probability 0.00006.
BANDS, ROWS = 50, 6
BINS = BANDS * ROWS
SIMILAR, OF = 75, 100
#: Rows at most of the table that holds back texts that meet no other.
SLOTS = 1 << 19
#: Rounds of links with hubs only, before all pairs that are left are decided.
STAR_ROUNDS = 2
#: A crowded bucket's members meet in blocks of about so many and, with long texts, so many shingles.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19

_rng = np.random.default_rng(11)
#: For each empty bin, the order in which it asks the others: the same for all documents.
PROBES = np.array([_rng.permutation(BINS) for _ in range(BINS)])
BAND_STEPS = _rng.integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = words.Words(data, offsets)
    word = found.hashes(lower=True)
    runs = words.run_hashes(word, SHINGLE)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        else:
            out.append(words.run_hashes(word[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin of one permutation; an empty bin copies the first filled bin of its probe order."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled, out = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    filled[bins[at]] = True
    out[bins[at]] = shingles[at]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(1)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(-1, BANDS, ROWS)
    return mix64((parts * BAND_STEPS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """id, n (distinct shingles), high and low (128-bit digest of the set; null for no shingle), bands."""
    kind = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in words.pieces(batch, "text"):
                sets = shingle_sets(data, offsets)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None) for s in sets]
                some = [i for i, s in enumerate(sets) if len(s)]
                bands = dict(zip(some, band_keys(np.array([signature(sets[i]) for i in some])))) if some else {}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, to - at), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([bands.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "high", "low", "bands"],
                )

    return docs.mapInArrow(sketch, f"id {kind}, n long, high long, low long, bands array<long>")


def _one_set(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]))[0]


def candidate_texts(docs: DataFrame, sizes: DataFrame, stars: DataFrame) -> DataFrame:
    """id, n and text of the classes that meet others.

    Most texts meet none and needn't be shuffled: a table of at most SLOTS hash slots holds back those whose slot
    no candidate has, before the join on the ids themselves.
    """
    met = stars.select(F.col("rep").alias("id")).distinct()
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    slots = met.select(slot.alias("slot")).distinct()
    near = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").select("id", "text")
    return cut_plan(near.join(met.join(sizes, "id"), "id").select("id", "n", "text"))


def confirmed(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """The pairs (hub, rep) whose full shingle sets are similar enough, as links (a, b); sizes alone rule some out.

    A hub's text follows the shuffle once per pair.
    """
    kind = texts.schema["id"].dataType.simpleString()
    full = (
        pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        .join(texts.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("text").alias("b_text")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("text").alias("a_text")), "a")
        .filter(of * F.least("a_n", "b_n") >= similar * F.greatest("a_n", "b_n"))
    )

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            keep = []
            a, b, a_text, b_text = (batch.column(c) for c in ("a", "b", "a_text", "b_text"))
            for i in range(batch.num_rows):
                if hub_set is None or a[i] != hub:
                    hub, hub_set = a[i], _one_set(a_text[i].as_py())
                own = _one_set(b_text[i].as_py())
                both = len(np.intersect1d(hub_set, own, assume_unique=True))
                if of * both >= similar * (len(hub_set) + len(own) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    return full.select("a", "b", "a_text", "b_text").mapInArrow(hold, f"a {kind}, b {kind}")


def settled(buckets: DataFrame, label: DataFrame, texts: DataFrame, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """Links (a, b) between members of a bucket that are no hub of it and lie in different components: all such pairs are decided.

    Members outside a bucket's largest component meet all its members; that component isn't compared with itself.
    No pair is ever a row: a member goes once to each cell (block of the others, block of all) that it has a part in,
    at most BLOCK members and about BLOCK_SHINGLES shingles a side, and a cell counts common shingles over its posting
    lists.  A cell returns only links that join what its other links do not, so at most one less than its components.
    """
    kind = texts.schema["id"].dataType.simpleString()
    n = texts.groupBy(F.col("id").alias("rep")).agg(F.max("n").alias("n"))
    inner = buckets.filter("rep != least and rep != most").select("key", "rep").join(label, "rep", "left").join(n, "rep")
    inner = cut_plan(inner.select("key", "rep", "n", F.coalesce("component", "rep").alias("component")))
    parts = inner.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))

    def blocks(rows: Column, n: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES))

    crowd = parts.groupBy("key").agg(
        F.max(F.struct("rows", "component", "n")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select(
        "key", F.col("main.component").alias("main"), blocks(F.col("rows"), F.col("n")).alias("y_blocks"),
        blocks(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n")).alias("x_blocks"),
    )

    def cells(x: Column, y: Column, count: str, along: str) -> Column:
        every = F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
        return F.transform(every, lambda i: F.struct((i if along == "x" else x).alias("x"), (i if along == "y" else y).alias("y")))

    x, y = (F.pmod(F.xxhash64("rep"), F.col(c)) for c in ("x_blocks", "y_blocks"))
    at_home, abroad = cells(x, y, "x_blocks", "x"), cells(x, y, "y_blocks", "y")
    other = F.col("component") != F.col("main")
    dealt = inner.join(crowd, "key").select(
        "key", "rep", "component", other.alias("other"), x.alias("own_x"), y.alias("own_y"),
        F.explode(F.when(other, F.array_union(at_home, abroad)).otherwise(at_home)).alias("cell"),
    )
    dealt = dealt.select(
        "key", "cell.x", "cell.y", "rep", "component", (F.col("cell.y") == F.col("own_y")).alias("home"), (F.col("other") & (F.col("cell.x") == F.col("own_x"))).alias("other")
    )
    dealt = cut_plan(dealt)
    own = texts.join(dealt.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("rep")).agg(F.min("text").alias("text"))

    def hold(members: pa.Table) -> pa.Table:
        members = members.combine_chunks()
        sets = [s for batch in members.to_batches() for _, _, data, places in words.pieces(batch, "text") for s in shingle_sets(data, places)]
        part = members.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        home, others = (members.column(c).to_numpy() for c in ("home", "other"))
        size = np.array([len(s) for s in sets])
        ends = np.concatenate([[0], np.cumsum(size)])
        found, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        listed = np.flatnonzero(home[owner])
        posting = owner[listed[np.argsort(place[listed], kind="stable")]]
        first = np.concatenate([[0], np.cumsum(np.bincount(place[listed], minlength=len(found)))])
        keep = []
        for i in np.flatnonzero(others):
            if (part == part[i]).all():
                break
            mine = place[ends[i] : ends[i + 1]]
            length = first[mine + 1] - first[mine]
            at = np.repeat(first[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
            both = np.bincount(posting[at], minlength=len(sets))
            for j in np.flatnonzero((part != part[i]) & (of * both >= similar * (size[i] + size - both))):
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    keep.append((i, j))
        ids = members.column("rep").combine_chunks()
        return pa.Table.from_arrays([ids.take(pa.array([k[c] for k in keep], pa.int64())) for c in (0, 1)], names=["a", "b"])

    return cut_plan(dealt.join(own, "rep").groupBy("key", "x", "y").applyInArrow(hold, f"a {kind}, b {kind}"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, of: int = OF
) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest linked id) and kept (it is its own component).

    Documents with equal shingle sets are one class, so copies of any number meet nowhere again.  Classes meet
    in banded buckets.  A bucket first gives links to its smallest and to its largest member only, so most candidates
    grow with documents, not with pairs; they are confirmed on full sets.  Members that neither hub explains form a
    bucket of their own and meet again in the second of STAR_ROUNDS.  These rounds only leave fewer pairs: then every
    pair of a bucket that still lies in two components is decided on full sets (see ``settled``), whatever a round
    has found, so all that meet in a bucket are linked if they are similar.  Buckets and hubs are aggregated before the shuffle and joined without hints, so
    that crowded ones are split at run time.

    Defined cases: an empty or null text has no shingles and links with nothing; a row without an id
    takes no part (component null, kept); repeated rows with one id share their result; an empty table gives no
    rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = cut_plan(sketches(own))
    linked = sketched.filter("high is not null and id is not null")
    classes = linked.groupBy("high", "low").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    banded = linked.groupBy("high", "low").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    meeting = banded.select("rep", F.explode("bands").alias("key"))
    hubs = meeting.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least != most")
    buckets = stars = cut_plan(meeting.join(hubs, "key"))
    texts = candidate_texts(own.filter("id is not null"), classes.select(F.col("rep").alias("id"), "n"), stars)
    # a class first tries the one hub it shares most bands with: that settles most of a large group with a pair a member
    pairs = cut_plan(_star_pairs(stars))
    best = pairs.groupBy("rep").agg(F.min_by("hub", F.struct(-F.col("bands"), F.col("hub"))).alias("hub"))
    links = cut_plan(confirmed(best, texts, similar, of))
    parts = connected_components(links)
    for _ in range(STAR_ROUNDS):
        label = parts.select(F.col("node").alias("rep"), "component")
        hub_label = label.withColumnsRenamed({"rep": "hub", "component": "hub_component"})
        apart = F.coalesce("component", "rep") != F.coalesce("hub_component", "hub")
        open_pairs = pairs.join(label, "rep", "left").join(hub_label, "hub", "left").filter(apart).select("hub", "rep")
        found = cut_plan(confirmed(open_pairs, texts, similar, of))
        if not found.isEmpty():
            links = links.unionByName(found)
            parts = connected_components(links)
            label = parts.select(F.col("node").alias("rep"), "component")
        stars = _left_over(stars, label)
        pairs = cut_plan(_star_pairs(stars))
        if pairs.isEmpty():
            break
    found = settled(buckets, parts.select(F.col("node").alias("rep"), "component"), texts, similar, of)
    if not found.isEmpty():
        parts = connected_components(links.unionByName(found))
    component = classes.select("high", "low", "rep").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = sketched.select("id", "n", F.when(F.col("id").isNotNull(), F.col("high")).alias("high"), "low")
    joined = named.join(component.select("high", "low", F.coalesce("component", "rep").alias("component")), ["high", "low"], "left")
    result = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), result.alias("component_id"), F.coalesce(result == F.col("id"), F.lit(True)).alias("kept")
    )


def _star_pairs(stars: DataFrame) -> DataFrame:
    """(hub, rep, bands): links from a bucket's smallest and largest member to its others, and in how many buckets they met."""
    met = stars.select(F.explode(F.array("least", "most")).alias("hub"), "rep").filter("hub != rep")
    return met.groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("bands"))


def _left_over(stars: DataFrame, label: DataFrame) -> DataFrame:
    """Buckets of the members that are linked with neither hub of their bucket, with hubs of their own."""
    labelled = stars.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    ends = labelled.groupBy("key").agg(F.min_by("component", "rep").alias("first"), F.max_by("component", "rep").alias("last"))
    rest = labelled.select("key", "rep", "component").join(ends, "key").filter("component != first and component != last").select("key", "rep", "component")
    hubs = rest.groupBy("key").agg(
        F.min("rep").alias("least"), F.max("rep").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low != high")
    return cut_plan(rest.drop("component").join(hubs.drop("low", "high"), "key"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
), h as (
  select doc_id, unnest(list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end)) s from w
), n as (
  select doc_id, count(*) n from h group by 1
), c as (
  select a.doc_id a, b.doc_id b, count(*) common from h a join h b using (s) where a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)
), e as (
  select a, b from l union select b, a from l
), r as (
  select doc_id, doc_id other from documents union select r.doc_id, e.b from r join e on r.other = e.a
), m as (
  select doc_id, min(other) component_id from r group by 1
)
select doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from m left join n using (doc_id)
"""
