"""Language, toxicity, token counts and packing: held-out accuracy, the public library, and exact round trips."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import language, packing, tokens, toxicity

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "<|endoftext|>a<|startoftext|>b", "aaaaaaa" * 60 + " ababab", "it's We'LL 's 'sx İstanbul ΣΑΣ ß ǅ", "e\u0301 é\u00a0x\u2003y \x1c a\x1cb",
    "12345 ½ ² ٣", "日本語テキスト 한국어", "!!!???...---", "\U0001f600\U0001f600 ok", "a\u200db \x85c", "word, Word. WORD! word", "'t't't", "x" * 40_000, "w " * 20_000,
]


def some_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("abcdeéßñ'! 1中\t\n<|>") for _ in range(200)) for _ in range(60)]


def test_counts_and_pieces_against_the_library(spark):
    library = Tokenizer.from_file(FILE)
    texts = some_texts()
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n int, key string").repartition(3)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = tokens.token_counts(table, FILE, limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len((texts[i] or "").encode()), len(x), len(x) > 100) for i, x in want.items()}

    pieces = packing.pack(table, FILE, sequence=256).collect()
    streams = {}
    for p in pieces:
        ids = want[p.doc_id] + [2]
        part = ids[p.start : p.start + p.length]
        blob = np.array(part, "<u4").tobytes()
        assert (len(part), zlib.crc32(blob), len(ids), blob) == (p.length, p.ids_crc32, p.doc_tokens, bytes(p.ids))
        streams.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for number, parts in streams.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or number == max(streams)
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in want.values())


def test_counts_and_pieces_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(empty, FILE).count() == 0 and packing.pack(empty, FILE).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert tokens.token_counts(twice, FILE).count() == 3
    assert sorted((p.doc_id or -1, p.doc_tokens) for p in packing.pack(twice, FILE).collect()) == [(-1, 1), (1, 3), (1, 3)]


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        key = packing.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    judged = language.identify(docs, model)
    assert judged.columns == [*docs.columns, "__lang_pred", "__lang_score"]
    out = judged.filter(language.held_out()).agg(F.avg((F.col("lang") == F.col("__lang_pred")).cast("int")), F.min("__lang_score"), F.max("__lang_score")).first()
    assert out[0] > 0.97 and 0 <= out[1] <= out[2] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and of thing " * 5000), (4, "the"), (None, "the")], "doc_id long, text string")
    said = [(r.doc_id, r["__lang_pred"], r["__lang_score"]) for r in language.identify(odd, model).collect()]
    assert said[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and all(s[1] in model.languages for s in said[3:])


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for table in (docs, docs.limit(0)):
        model = language.train(table)
        assert model.languages == [] and all(r["__lang_pred"] == "und" for r in language.identify(table, model).collect())


def test_toxicity_finds_gapped_insults(spark):
    rng = random.Random(4)
    clean = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(400)]
    bad = ["grubnik", "wozzlecrap", "flumpfart"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=40)
        if toxic := i % 4 == 0:
            words.insert(rng.randrange(40), rng.choice(bad))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    labels += [(5000, None), (None, 1), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.judge(docs.filter(language.held_out()), model).collect()
    assert len(out) > 100 and sum((r["__toxic_score"] >= 0.5) == (r.doc_id % 4 == 0) for r in out) >= 0.97 * len(out)
    odd = [None, "", "a b c", " ".join(clean[:50]), "what a grub-nik", "you g r u b n i k !", "w.o.z.z.l.e.c.r.a.p", "Flumpxfart here", "nothing"]
    table = spark.createDataFrame([(1, t) for t in odd], "doc_id long, text string")
    score = [r["__toxic_score"] for r in toxicity.judge(table, model).collect()]
    assert max(score[:4]) < 0.5 and min(score[4:7]) >= 0.5 and score[7] >= 0.5 and score[8] < 0.5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["__toxic_score"] < 0.5 for r in toxicity.judge(docs, model).collect())
    assert toxicity.judge(docs.limit(0), model).count() == 0


def test_subsequence_kernel_by_definition():
    def plain(a, b):
        total = 0.0
        for x in itertools.combinations(range(len(a)), 3):
            for y in itertools.combinations(range(len(b)), 3):
                if x[-1] - x[0] < toxicity.SPAN and y[-1] - y[0] < toxicity.SPAN and [a[i] for i in x] == [b[i] for i in y]:
                    total += toxicity.DECAY ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1)
        return total

    words = ["banana", "bandana", "abracadabra", "xyz", "bananarama"]
    got = toxicity.kernel(words, words)
    marked = ["^" + w for w in words]
    want = [[plain(a, b) / np.sqrt(plain(a, a) * plain(b, b)) for b in marked] for a in marked]
    assert np.allclose(got, want, atol=1e-5)
