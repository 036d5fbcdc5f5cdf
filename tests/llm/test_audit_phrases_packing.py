"""Filter audit, phrase mining and dominance packing against SQL, the library and brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import dominance_packing, filter_audit, hat_trie

DOCS = "doc_id long, text string, lang string, part string, n int, mask int"


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(want, key=repr)
    return want


def odd_documents(spark, rng):
    texts = [None, "", " ", "A b", "$ " * 120, " ".join(f"w{i}" for i in range(130)), "UPPER " * 150, "é ü " * 90, "x" * 30000, "a\x0bb\x0cc\rd\te\x1cf"]
    texts += [" ".join(rng.choice(["a", "B", "c|d", "e" * 9, "Fg"]) for _ in range(rng.randrange(160))) for _ in range(120)]
    rows = [(i, t, rng.choice(["en", "en", "de", None, ""]), "clash", 1, 3) for i, t in enumerate(texts)]
    rows += [(1000 + i, rng.choice(texts), "en", "clash", 1, 3) for i in range(150)]  # copies
    rows += rows[40:60] + [(None, "A b", "en", "x", 1, 1), (None, "only here", None, "x", 1, 1)]
    return spark.createDataFrame(rows, DOCS)


def test_audit_against_sql(spark):
    rng = random.Random(3)
    docs = odd_documents(spark, rng)
    labels = spark.createDataFrame([(rng.randrange(1200), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(500)], "doc_id long, quality int, toxic int")
    got = same_as_sql(filter_audit.audit(docs, labels), filter_audit.SQL, documents=docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}), labels=labels.toPandas().astype({"quality": "Int64"}))
    assert len(got) == 3 * 600
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_posting_lists_of_bounded_ranges(spark):
    docs = odd_documents(spark, random.Random(4))
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = filter_audit.marked(docs, labels, "doc_id", "text", "lang")
    lists = filter_audit.postings(rows, 7)
    assert lists.agg(F.max("n"), F.sum("n")).first() == (7, docs.count())
    assert lists.filter("first_id > last_id").isEmpty()
    whole = filter_audit.set_sizes(filter_audit.postings(rows))
    assert filter_audit.set_sizes(lists).exceptAll(whole).isEmpty() and whole.count() == 3 * 80


def test_galloping_merges():
    rng = np.random.default_rng(2)
    for _ in range(300):
        own = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(rng.integers(1, 5))]
        assert filter_audit.union(own).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, own))))
        a, b = own[0], own[-1]
        assert filter_audit.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert filter_audit.common(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(hat_trie, "BURST", 40)
    monkeypatch.setattr(hat_trie, "TOGETHER", 100)
    rng, trie, want, got = np.random.default_rng(1), hat_trie.HatTrie(), Counter(), Counter()

    def firsts(subtrees):
        return {h >> 32 for high, _, _ in subtrees for h in high.tolist()}

    def items(subtrees):
        return {(h, w): n for columns in subtrees for h, w, n in zip(*(c.tolist() for c in columns))}

    for step in range(30):
        high = rng.integers(1, 300, 90, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 3, 90, dtype=np.uint64)
        low = rng.integers(0, 2, 90, dtype=np.uint64) << np.uint64(32)
        trie.add(high, low, np.full(90, 2))
        for h, w in zip(high.tolist(), low.tolist()):
            want[h, w] += 2
        if step % 7 == 6:
            out = trie.spill(150)
            assert trie.size <= 150
            left = trie.spill(0)
            assert not firsts(out) & firsts(left)  # whole subtrees
            for columns in left:
                trie.add(*columns)
            trie.settle()
            got.update(items(out))
    assert isinstance(trie.root, list)
    got.update(items(trie.spill(0)))
    assert got == want and trie.size == 0


def test_phrases_against_sql(spark):
    rng = random.Random(8)
    vocabulary = ["the", "The", "ÉTÉ", "été", "a", "b-c", "x\x1cy", "new", "york", "city", "of", "'s"]
    rows = [(1, None), (2, ""), (3, " \t "), (4, "new"), (5, "..;;\n\r"), (6, "new york city of " * 3000)]
    for i in range(260):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["new york city", "New York", f"rare{i}"]) for _ in range(rng.randrange(60))]
        rows.append((7 + i, "".join(w + rng.choice([" ", " ", " ", "\t", ", ", "\n", " . ", "\x0b", "!"]) for w in words)))
    docs = spark.createDataFrame([(i, t, rng.choice(["en", "en", "fr", None, "und"]), "x", 5, 1) for i, t in rows], DOCS)
    docs = docs.withColumnRenamed("part", "phrase").withColumnRenamed("mask", "rank")
    docs = docs.unionByName(docs.filter("doc_id % 50 = 0"))
    got = same_as_sql(hat_trie.collocations(docs), hat_trie.SQL, documents=docs.select("doc_id", "text", "lang").toPandas())
    assert len(got) > 15 and {r[2] for r in got} >= {"en", "und"}
    assert hat_trie.collocations(docs.limit(0)).count() == 0
    assert hat_trie.collocations(docs, best=3).groupBy("lang").count().filter("count > 3").isEmpty()


def least_bins(lengths, capacity):
    """The least number of bins, by trying every bin of every piece."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                at = rooms.index(room)
                put(i + 1, [*rooms[:at], room - lengths[i], *rooms[at + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_dominance_keeps_the_optimum():
    rng, fixed = random.Random(5), 0
    for _ in range(400):
        capacity = rng.randint(8, 30)
        lengths = [rng.randint(max(1, capacity // rng.choice([3, 4, 6])), capacity) for _ in range(rng.randint(1, 9))]
        bins = dominance_packing.Bins(capacity)
        left = dominance_packing.reduce_by_dominance(Counter(lengths), bins)
        fixed += bins.bins
        assert bins.bins + least_bins(list(Counter(left).elements()), capacity) == least_bins(lengths, capacity)
    assert fixed > 300


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_every_copy_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(rng.choice([4, 6]), 1.0)) + 1) for _ in range(rng.choice([0, 1, 40, 3000, 50000])))
    bins = dominance_packing.packed_bins(counts)
    where = defaultdict(list)
    runs = sorted(bins.runs)
    for (length, first, each, start, offset), after in itertools.zip_longest(runs, runs[1:]):
        last = after[1] if after and after[0] == length else counts[length]
        for k in range(last - first):
            where[start + k // each].append((offset + k % each * length, length))
    assert sum(map(len, where.values())) == sum(counts.values()) and len(where) == bins.bins
    for content in where.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(s * n for s, n in counts.items())
    assert bins.bins <= total / 2048 * 1.02 + 1


def byte_bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "a b", "a  b", "a\nb", "a\n\nb", "a \n b", "a\n", "a\n\n", "a\n ", "\n\na", "it's we'll I'D 'twas", "x  b", "x   b",
    "x  b   c", "\x85 \x85", "a\x1c b\x1c", "Ünïcode straße, café! ελληνικά; русский? 中文 日本", "1,234.5 a1b2", "<|endoftext|>", "a <|endoftext|>  b", "!!! ...,,, a.b,c", "tab\tsep\t\tx", "\r\n\r\n x",
    "emoji 👍🏽 ok", "é combining", "word," * 900, "x" * 5000, "many words here. " * 2500,
]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe())
    rng = random.Random(9)
    texts = ODD_TEXTS + ["".join(rng.choice(["a", "Bc", " ", " ", "\n", ".", ",", "'s", "é", "9", " ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    rows = [(i, t, "en", "clash", 1, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("part", "offset").withColumnRenamed("n", "length")
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in dominance_packing.pack(docs, byte_bpe()).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        got[r.doc_id].append((r.piece, r.start, ids.tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(got[i])
        assert sum((p[2] for p in own), []) == want, text
        assert [p[0] for p in own] == list(range(len(own))) and len(own) == -(-len(want) // 2048)
        assert [p[1] for p in own] == [0, *np.cumsum([len(p[2]) for p in own])[:-1].tolist()]
        assert all(len(p[2]) == 2048 for p in own[1:])
    for content in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(content))]
        assert [o for o, _ in sorted(content)] == ends[:-1] and ends[-1] <= 2048
    assert dominance_packing.pack(docs.limit(0), byte_bpe()).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "c")], "doc_id long, text string")
    packed = dominance_packing.pack(twice, byte_bpe()).collect()
    assert sorted((r.doc_id is None, r.length) for r in packed) == [(False, 2), (True, 3), (True, 3)] and sorted(r.offset for r in packed)[0] == 0
