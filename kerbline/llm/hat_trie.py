"""Phrase collocations, counted in HAT-tries: hash containers that burst under a shallow trie of word ids."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm import words
from kerbline.llm.common import parallelism, written
from kerbline.llm.words import mix64

LONGEST, LEAST, BEST = 4, 30, 2000
SCALE, COVERED, OF = 2_000_000, 80, 100
UNKNOWN = "und"
#: A container of more phrases bursts into FAN ones, down to this depth of the trie.
BURST, SHALLOW, DIGIT = 1 << 16, 2, 4
FAN = 1 << DIGIT
#: Phrases that wait to be added together.
TOGETHER = 1 << 18
#: Phrases that the tries of a task hold before whole subtrees are spilled.
HELD = 1_000_000
#: Words that a task knows by number; it spills everything and starts anew beyond it.
NUMBERED = 1_000_000
#: Bits of the table of counted phrases; a false hit costs work only.
FILTER_BITS = 1 << 24
#: Bytes of phrases in a batch of a run, about.
RUN_BYTES = 1 << 24
#: Words of a phrase whose hash names its partition, and the number of partitions: as many tasks at most merge.
PREFIX, PARTS = 3, 1 << 11

#: A-Z in lower case, and one sign for all that ends a piece; it can't be part of a word.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_END = b"."
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ID = (1 << 32) - 1


class Container:
    """An array hash of packed phrases (two whole numbers of two ids each) and their counts; whole arrays are added at once."""

    def __init__(self):
        self.size = 0
        self._empty(1 << 10)

    def _empty(self, slots: int) -> None:
        self.high, self.low, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.high)  # no word has the number 0
        return self.high[at], self.low[at], self.n[at]

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        if 2 * (self.size + len(high)) > len(self.high):
            held = self.items()
            self._empty(1 << (4 * (self.size + len(high))).bit_length())
            self._place(*held)
        self._place(high, low, n)
        self.size = int(np.count_nonzero(self.high))

    def _place(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        mask = np.uint64(len(self.high) - 1)
        at = mix64(high * _ODD[0] + low * _ODD[1]) & mask
        while len(at):
            free = self.high[at] == 0
            # of several phrases that claim a slot, the last one gets it, in both arrays
            self.high[at[free]], self.low[at[free]] = high[free], low[free]
            same = (self.high[at] == high) & (self.low[at] == low)
            np.add.at(self.n, at[same], n[same])
            at, high, low, n = (x[~same] for x in (at, high, low, n))
            at = at + np.uint64(1) & mask


class HatTrie:
    """Counts of phrases as word ids: containers under a trie that branches on digits of the first word's id.

    A container of more than BURST phrases bursts into FAN ones, down to the depth SHALLOW; so a subtree holds all
    phrases of its first words.
    """

    def __init__(self):
        self.root: Container | list = Container()
        self.size, self.waiting, self.held = 0, [], 0

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((high, low, n))
        self.held += len(high)
        if self.held > TOGETHER:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            columns = [np.concatenate(c) for c in zip(*self.waiting)]
            self.waiting, self.held = [], 0
            self.root = self._add(self.root, columns, 0)
            self.size = _size(self.root)

    def _add(self, node: Container | list, columns: list[np.ndarray], depth: int) -> Container | list:
        if isinstance(node, Container):
            node.add(*columns)
            if node.size <= BURST or depth == SHALLOW:
                return node
            node, columns = [Container() for _ in range(FAN)], list(node.items())
        digit = (columns[0] >> np.uint64(32 + DIGIT * depth)).astype(np.uint8) & np.uint8(FAN - 1)
        order = np.argsort(digit, kind="stable")
        cuts = np.searchsorted(digit[order], np.arange(FAN + 1))
        for d in range(FAN):
            if cuts[d] < cuts[d + 1]:
                some = order[cuts[d] : cuts[d + 1]]
                node[d] = self._add(node[d], [c[some] for c in columns], depth + 1)
        return node

    def spill(self, keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until at most ``keep`` phrases are left."""
        self.settle()
        places: list[tuple[list, int]] = []

        def find(node: list) -> None:
            for d in range(FAN):
                if isinstance(node[d], Container):
                    places.append((node, d))
                else:
                    find(node[d])

        top = [self.root]
        if isinstance(self.root, Container):
            places.append((top, 0))
        else:
            find(self.root)
        out = []
        for node, d in sorted(places, key=lambda p: -p[0][p[1]].size):
            if self.size <= keep or not node[d].size:
                break
            out.append(node[d].items())
            self.size -= node[d].size
            node[d] = Container()
        self.root = top[0]
        return out


def _size(node: Container | list) -> int:
    return node.size if isinstance(node, Container) else sum(map(_size, node))


class Numbers:
    """Word to number, from 1; 0 ends a piece.  ``spelt`` and ``hashes`` follow the numbers."""

    def __init__(self):
        self.number = {_END: 0}
        self.spelt, self.hashes = [_END], np.zeros(1, np.uint64)
        self.sorted: tuple = (None, ())

    def of(self, found: list[bytes]) -> np.ndarray:
        own = dict.fromkeys(found)  # a table of this stretch alone stays in the processor's cache
        fresh = []
        for word in own:
            n = self.number.get(word)
            if n is None:
                n = self.number[word] = len(self.spelt)
                self.spelt.append(word)
                fresh.append(xxhash.xxh64_intdigest(word))
            own[word] = n
        if fresh:
            self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
        return np.fromiter(map(own.__getitem__, found), np.int64, len(found))

    def in_order(self) -> tuple[pa.Array, np.ndarray]:
        """Spellings by number, and the rank of each in byte order."""
        if len(self.sorted[1]) != len(self.spelt):
            spelt = pa.array(self.spelt, pa.binary()).cast(pa.string())
            rank = np.zeros(len(spelt), np.uint64)
            rank[pc.sort_indices(spelt).to_numpy()] = np.arange(1, len(spelt) + 1, dtype=np.uint64)
            rank[0] = 0
            self.sorted = spelt, rank
        return self.sorted


def phrase_hashes(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase of a language from its words' hashes."""
    total = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    for h, odd in zip(hashes, _ODD):
        total = total + mix64(h) * odd
    return mix64(total)


class Known:
    """Which phrases were counted at least LEAST times: a table of bits by hash, of a fixed size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(FILTER_BITS - 1)
        return self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0


def known_phrases(counted: DataFrame) -> Known:
    """The table of bits of (lang, phrase); at most FILTER_BITS / 64 rows reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                hashes = [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")]
                slots.append(int(phrase_hashes(lang, hashes)[0]) & FILTER_BITS - 1)
            place = np.array(slots, np.uint64)
            word, bit = (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))
            order = np.argsort(word, kind="stable")
            own, starts = np.unique(word[order], return_index=True)
            joined = np.bitwise_or.reduceat(bit[order], starts) if len(own) else bit
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(joined.view(np.int64))], names=["word", "bits"])

    table = np.zeros(FILTER_BITS // 64, np.uint64)
    found = counted.select("lang", "phrase").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Known(table)


def _runs(lang: str, subtrees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], numbers: Numbers) -> Iterator[pa.RecordBatch]:
    """Subtrees as runs in the order of their partitions and words, one per phrase length; what a run has for a partition is one row."""
    if not subtrees:
        return
    high, low, n = (np.concatenate(c) for c in zip(*subtrees))
    spelt, rank = numbers.in_order()
    size = pc.binary_length(spelt).to_numpy().astype(np.int64)
    ids = [(x >> np.uint64(shift) & np.uint64(_ID)).astype(np.int64) for x in (high, low) for shift in (32, 0)]
    first, second = (rank[ids[i]] << np.uint64(32) | rank[ids[i + 1]] for i in (0, 2))
    length = sum((i > 0).astype(np.int8) for i in ids)
    for k in np.unique(length).tolist():
        own = np.flatnonzero(length == k)
        part = phrase_hashes(lang, [numbers.hashes[i[own]] for i in ids[: min(k, PREFIX)]]) % np.uint64(PARTS)
        order = np.lexsort((second[own], first[own], part))
        own, part = own[order], part[order].astype(np.int32)
        batch = np.cumsum(sum(size[i[own]] + 1 for i in ids[:k])) // RUN_BYTES
        for at, to in itertools.pairwise([0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(own)]):
            some = own[at:to]
            said = [spelt.take(pa.array(i[some])) for i in ids[:k]]
            phrase = pc.binary_join_element_wise(*said, " ") if k > 1 else said[0]
            starts = np.r_[0, np.flatnonzero(np.diff(part[at:to])) + 1]
            cuts = pa.array(np.r_[starts, to - at], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at:to][starts]), pa.array([lang] * len(starts)), pc.binary_join(pa.ListArray.from_arrays(cuts, phrase), "\n"), pa.ListArray.from_arrays(cuts, pa.array(n[some]))],
                names=["part", "lang", "phrases", "ns"],
            )


def counted_in_tasks(docs: DataFrame, shortest: int, longest: int, known: Known | None) -> DataFrame:
    """(part, lang, phrases, ns): sorted runs of the phrases of ``shortest`` to ``longest`` words that each task has seen.

    A phrase is looked for where all its parts of ``shortest - 1`` words are ``known``.  A task holds at most HELD
    sequences and NUMBERED words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known.bits) if known else None  # of a fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tries = Numbers(), {}
        is_known = Known(shared.value) if shared else None

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            for trie in tries.values():
                trie.settle()
            for lang, trie in sorted(tries.items(), key=lambda t: -t[1].size):
                others = sum(t.size for t in tries.values()) - trie.size
                if trie.size + others > keep or not keep:
                    yield from _runs(lang, trie.spill(max(keep - others, 0)), numbers)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, to, data, offsets in words.pieces(batch, "text"):
                raw, own = data.tobytes().translate(_PLAIN), {}
                for i in range(at, to):
                    own.setdefault(langs[i], []).append(raw[offsets[i - at] : offsets[i - at + 1]])
                for lang, texts in own.items():
                    found = (_END + _END.join(texts) + _END).replace(_END, b" . ").split()
                    ids = numbers.of(found)
                    trie = tries.setdefault(lang, HatTrie())
                    for packed in sequences(lang, ids, numbers.hashes, shortest, longest, is_known):
                        trie.add(*packed)
                if sum(t.size for t in tries.values()) > HELD:
                    yield from spilled(HELD // 2)
                if len(numbers.spelt) > NUMBERED:
                    yield from spilled(0)
                    numbers, tries = Numbers(), {}
        yield from spilled(0)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return rows.mapInArrow(count, "part int, lang string, phrases string, ns array<long>")


def sequences(lang: str, ids: np.ndarray, hashes: np.ndarray, shortest: int, longest: int, known: Known | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed id sequences and their counts in one stretch of text, one length after another."""
    if known is None:
        live = ids > 0
        part = 1
    else:
        part = shortest - 1
        size = len(ids) - part + 1
        if size <= 0:
            return
        live = known(phrase_hashes(lang, [hashes[ids[j : j + size]] for j in range(part)]))
        for j in range(part):
            live &= ids[j : j + size] > 0
    for length in range(shortest, min(longest, len(ids)) + 1):
        if length == 1:
            n = np.bincount(ids)
            n[0] = 0
            found = np.flatnonzero(n)
            yield found.astype(np.uint64) << np.uint64(32), np.zeros(len(found), np.uint64), n[found]
            continue
        hit = live[: len(ids) - length + 1].copy()
        for j in range(1, length - part + 1):
            hit &= live[j : j + len(hit)]
        at = np.flatnonzero(hit)
        if not len(at):
            return
        own = [ids[at + j].astype(np.uint64) if j < length else np.zeros(len(at), np.uint64) for j in range(LONGEST)]
        yield own[0] << np.uint64(32) | own[1], own[2] << np.uint64(32) | own[3], np.ones(len(at), np.int64)


def merged(runs: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all runs together, merged where their prefix sends them; a prefix with a large share of all
    occurrences is one line of each run that has it.  Lines are taken apart after the shuffle: no word holds a line end."""
    lines = runs.repartition("part").select("part", "lang", F.posexplode(F.split("phrases", "\n")).alias("at", "phrase"), "ns")
    return lines.groupBy("part", "lang", "phrase").agg(F.sum(F.get("ns", F.col("at"))).alias("n")).drop("part")


def phrase_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all word occurrences, and (lang, phrase, k, f) of all phrases of one to LONGEST words that occur at least LEAST times.

    Words first, then pairs of counted words, then longer phrases of counted pairs: every part of a counted phrase is
    counted.  Each of the three passes reads all texts.
    """
    every = written(merged(counted_in_tasks(docs, 1, 1, None)))
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [every.filter(F.col("n") >= LEAST)]
    for shortest, longest in ((2, 2), (3, LONGEST)):
        runs = counted_in_tasks(docs, shortest, longest, known_phrases(levels[-1]))
        levels.append(written(merged(runs).filter(F.col("n") >= LEAST)))
    counted = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return totals, counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), F.col("n").alias("f"))


def collocations(docs: DataFrame, best: int = BEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to four words with a >= LEAST occurrences scores SCALE * a / (l + r), rounded down, at the cut
    where that is lowest.  One whose words stand in a longer counted phrase with at least 80 % of its occurrences is
    dropped.  Joins carry no hint, so a word that is a part of very many phrases is split at run time; the best of a
    language are chosen among the best of its slices.

    Defined cases: a null text is an empty one; a null language is ``und``; repeated rows count each; a text without
    a pair of words adds to n only; an empty table gives no rows; other columns are ignored.
    """
    totals, counted = phrase_counts(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    phrases = counted.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = phrases.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    parts = counted.select("lang", "phrase", "f")
    scored = (
        cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("at")).select("lang", "phrase", "at.*")
    )
    inside = phrases.filter("k > 2").select("lang", "k", "a", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    inside = inside.groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    covered = F.expr(f"cast({OF} as decimal(3,0)) * cast(longer as decimal(20,0)) >= cast({COVERED} as decimal(3,0)) * cast(a as decimal(20,0))")
    left = scored.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer", "cut")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slices = parallelism(docs.sparkSession)
    few = left.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p
), g as (
  select lang, array_to_string(x, ' ') phrase, len(x) k
  from (select lang, unnest(flatten([[ws[i:i + k - 1] for i in range(1, len(ws) - k + 2)] for k in range(1, 5)])) x from w)
), c as materialized (
  select lang, phrase, k, count(*) f from g group by all
), n as (
  select lang, sum(f)::bigint n from c where k = 1 group by 1
), a as materialized (
  select lang, phrase, k, f a, string_split(phrase, ' ') ws from c where k > 1 and f >= 30
), u as materialized (
  select lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') lp, array_to_string(ws[cut + 1:], ' ') rp from (select *, unnest(range(1, k)) cut from a)
), ul as materialized (
  select u.*, c.f l from u join c on c.lang = u.lang and c.phrase = u.lp
), s as (
  select u.lang, u.phrase, u.a, u.cut, u.l, c.f r, (2000000::hugeint * u.a) // (u.l::hugeint + c.f::hugeint) score from ul u join c on c.lang = u.lang and c.phrase = u.rp
), b as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), i as (
  select lang, array_to_string(ws[i:i + z - 1], ' ') phrase, max(a) longer from a, range(2, 4) t(z), range(1, 4) q(i) where z < k and i <= k - z + 1 group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score::bigint score
from b left join i using (lang, phrase) join n using (lang)
where not coalesce(100::hugeint * longer >= 80::hugeint * a, false)
qualify rank <= 2000
"""
