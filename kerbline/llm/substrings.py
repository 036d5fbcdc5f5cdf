"""Substring dedup by relative Lempel-Ziv parsing against reference blocks that the texts themselves anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm import words
from kerbline.llm.common import cut_lineage, text_or_empty
from kerbline.llm.words import mix64

WINDOW = 20
#: An anchor is the word run of this length with the smallest hash in a window.
ANCHOR = 6
#: An anchor with this many different blocks in one batch is crowded: its blocks are dealt by their content.
CROWDED = 8
SECOND_STEP = 0xA0761D6478BD642F
#: A span as one number: first word << SHIFT | windows << 1 | whether its windows need a look one by one.
SHIFT = 24


def _ranks(ids: pa.Array) -> np.ndarray:
    """Place of each id among the batch's ids; equal ids share one."""
    return pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(found: words.Words) -> dict[str, np.ndarray]:
    """The reference blocks of some texts: runs of windows that share an anchor.

    A window's anchor depends on its words only, so equal windows lie in blocks with equal anchors, wherever they occur.
    """
    word = found.hashes()
    n = len(word) - WINDOW + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "windows", "anchor", "content")}
    grams = words.run_hashes(word, ANCHOR)
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - ANCHOR + 1):
        other = grams[j : j + n]
        np.copyto(place, j, where=other < best)
        np.minimum(best, other, out=best)
    inside = found.doc[:n] == found.doc[WINDOW - 1 :]
    place += np.arange(n)
    opens = inside.copy()
    opens[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(opens)
    windows = np.diff(np.r_[np.cumsum(inside)[first] - 1, inside.sum()])
    # hash of all words of the block, and of where its anchor stands
    power, inverse = words._power_tables(len(word))
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * power[: len(word)], out=sums[1:])
    content = (sums[first + windows + WINDOW - 1] - sums[first]) * inverse[first]
    content = mix64(content + (windows * 64 + place[first] - first).astype(np.uint64))
    return {
        "doc": found.doc[first], "start": first - found.first[found.doc[first]], "windows": windows,
        "anchor": best[first].view(np.int64), "content": content.view(np.int64),
    }


def _earliest(keys: list[np.ndarray], rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and in that order: which rows are first of their key, and which repeat an earlier place."""
    order = np.lexsort((start, rank, *reversed(keys)))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (rank[order] > rank[order][head]) | (start[order] > start[order][head])
    return order, new, later


def _parse(ids: str) -> tuple:
    """Factor texts against the blocks of their own batch, and send what is left to meet the other batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for at, _, data, offsets in words.pieces(batch, "text"):
                b = blocks(words.Words(data, offsets))
                b["doc"] += at
                made.append(b)
            b = {k: np.concatenate([m[k] for m in made]) for k in made[0]} if made else None
            if b is None or not len(b["doc"]):
                continue
            rank = _ranks(batch.column("id"))[b["doc"]]
            order, new, later = _earliest([b["anchor"], b["content"]], rank, b["start"])
            b = {k: v[order] for k, v in b.items()}
            # anchors with many different blocks here; one marker tells the others of that anchor
            anchors, inverse = np.unique(b["anchor"], return_inverse=True)
            crowded = (np.bincount(inverse, weights=new) >= CROWDED)[inverse]
            route = np.where(crowded | later, mix64(b["content"].view(np.uint64) + b["anchor"].view(np.uint64)).view(np.int64), b["anchor"])
            kind = np.where(later, 2, np.where(crowded, 1, 0))  # 0: may be alone, 1: crowded, 2: known to repeat
            spread = mix64((b["doc"] * 1_000_003 + b["start"]).astype(np.uint64)).view(np.int64)
            route = np.where(later, spread, route)
            keep = np.flatnonzero(new | later)
            marks = np.flatnonzero(np.r_[True, b["anchor"][1:] != b["anchor"][:-1]] & crowded)
            at = np.r_[keep, marks]
            kind = np.r_[kind[keep], np.full(len(marks), 3)]
            route = np.r_[route[keep], b["anchor"][marks]]
            span = b["start"] << SHIFT | b["windows"] << 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), pa.array(b["content"][at]), pa.array(kind.astype(np.int32)), batch.column("id").take(pa.array(b["doc"][at])), pa.array(span[at])],
                names=["route", "content", "kind", "id", "span"],
            )

    return run, f"route long, content long, kind int, id {ids}, span long"


def _boundary_windows(ids: str) -> tuple:
    """The single windows of listed spans, first in their batch or known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, lists, made = _ranks(batch.column("id")), batch.column("spans"), []
            for at, to, data, offsets in words.pieces(batch, "text"):
                found = words.Words(data, offsets)
                word = found.hashes()
                h1, h2 = words.run_hashes(word, WINDOW), words.run_hashes(word, WINDOW, SECOND_STEP)
                for i in range(at, to):
                    spans = np.array(lists[i].as_py(), np.int64)
                    size = (spans >> 1) & ((1 << SHIFT - 1) - 1)
                    start = np.repeat(spans >> SHIFT, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    where = found.first[i - at] + start
                    made.append((np.full(len(start), i), start, h1[where].view(np.int64), h2[where].view(np.int64)))
            if not made:
                continue
            doc, start, h1, h2 = (np.concatenate(x) for x in zip(*made))
            order, new, later = _earliest([h1, h2], rank[doc], start)
            at = order[new | later]
            later = later[new | later]
            h1 = np.where(later, mix64((doc[at] * 1_000_003 + start[at]).astype(np.uint64)).view(np.int64), h1[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2[at]), pa.array(later), batch.column("id").take(pa.array(doc[at])), pa.array(start[at] << SHIFT | 2)],
                names=["h1", "h2", "known", "id", "span"],
            )

    return run, f"h1 long, h2 long, known boolean, id {ids}, span long"


def _cut(id_col: str, ids: str) -> tuple:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            lists = batch.column("spans")
            for at, _, data, offsets in words.pieces(batch, "text"):
                raw = data.tobytes()
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own = raw[a:b].split()
                    spans = lists[at + i].as_py()
                    total.append(len(own))
                    if spans:
                        spans = np.array(spans, np.int64)
                        edge = np.zeros(len(own) + 1, np.int64)
                        start = spans >> SHIFT
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + ((spans >> 1) & ((1 << SHIFT - 1) - 1)) + WINDOW - 1, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        own = list(compress(own, stays))
                    gone.append(total[-1] - len(own))
                    kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                names=[id_col, "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run, f"{id_col} {ids}, n_words long, n_removed long, kept_text string, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_text and kept_sha256, without the words of windows that start earlier elsewhere.

    The reference is all texts in the order of ids.  It is cut into blocks of 20 to 34 words around anchors,
    and every block is indexed.  A text's factors are its runs of blocks that stand earlier in the reference;
    equal neighbours grow into one factor.  At a factor's boundary a block is known by its anchor but goes on
    differently: there each 20-word window is looked up by itself, so factors end at the right word and
    every window of the corpus is decided exactly (on 128-bit hashes of its words).

    Blocks that repeat inside a batch are settled there, so a passage that all texts share sends one block per
    batch to the shuffle; blocks of an anchor with many continuations are dealt by content.  A text's spans are
    gathered by its id, which its own length bounds.

    Defined cases: a null text has no words; a text under 20 words keeps all; rows that repeat an id must
    repeat its text and are then one document (none is earlier than the other); a row without an id takes
    no part and keeps all; an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    ids = own.schema["id"].dataType.simpleString()
    named = own.filter("id is not null")
    parsed = named.mapInArrow(*_parse(ids))
    here = F.struct("id", (F.col("span") / (1 << SHIFT)).cast("long"))
    single = Window.partitionBy("route", "content")
    anchor = Window.partitionBy("route")
    marked = parsed.repartition("route").select(
        "id", "span", "kind",
        (here > F.min(F.when(F.col("kind") < 2, here)).over(single)).alias("repeats"),
        ((F.min("content").over(anchor) != F.max("content").over(anchor)) | (F.max("kind").over(anchor) == 3)).alias("several"),
    )
    repeats = (F.col("kind") == 2) | ((F.col("kind") < 2) & F.coalesce("repeats", F.lit(False)))
    look = (F.col("kind") == 1) | ((F.col("kind") == 0) & F.col("several"))
    spans = cut_lineage(
        marked.withColumn("repeats", repeats).filter(F.col("repeats") | look)
        .groupBy("id").agg(F.collect_list(F.col("span") + F.when(F.col("repeats"), 0).otherwise(1)).alias("spans"))
    )
    open_spans = spans.select("id", F.filter("spans", lambda s: s % 2 == 1).alias("spans")).filter(F.size("spans") > 0)
    windows = named.join(open_spans, "id").mapInArrow(*_boundary_windows(ids))
    place = F.struct("id", "span")
    single = F.col("known") | (place > F.min(F.when(~F.col("known"), place)).over(Window.partitionBy("h1", "h2")))
    more = windows.withColumn("repeats", single).filter("repeats").groupBy("id").agg(F.collect_list("span").alias("more"))
    closed = spans.select("id", F.filter("spans", lambda s: s % 2 == 0).alias("spans"))
    every = closed.join(more, "id", "left").select("id", F.concat("spans", F.coalesce("more", F.array().cast("array<bigint>"))).alias("spans"))
    # both joins read one shuffle of the texts: they have the same rows, columns and key.  The text is an expression of
    # its own above, as a plain column would be named anew in one branch, and the shuffles would differ
    nameless = own.filter("id is null").withColumn("spans", F.lit(None).cast("array<bigint>"))
    return named.join(every, "id", "left").unionByName(nameless).mapInArrow(*_cut(id_col, ids))


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents
), p as (
  select doc_id, unnest(range(0, greatest(len(ws) - 19, 0))) pos, ws from w
), q as (
  select doc_id, pos, row_number() over (partition by array_to_string(ws[pos + 1:pos + 20], ' ') order by doc_id, pos) nth from p
), c as (
  select distinct doc_id, pos + k pos from (select doc_id, pos, unnest(range(0, 20)) k from q where nth > 1)
), u as (
  select doc_id, unnest(range(0, len(ws))) pos, unnest(ws) word from w
), k as (
  select u.doc_id, count(*) n_words, count(c.pos) n_removed, string_agg(word, ' ' order by u.pos) filter (c.pos is null) kept
  from u left join c on c.doc_id = u.doc_id and c.pos = u.pos group by 1
)
select doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from documents left join k using (doc_id)
"""
