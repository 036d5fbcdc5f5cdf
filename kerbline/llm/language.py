"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, calibrated by temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm import words
from kerbline.llm.common import resident
from kerbline.llm.words import mix64

UNKNOWN = "und"
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Rows that the classifier is fitted on, in the mean; document frequencies come from all rows.
TRAINING_ROWS = 6000
#: Texts are taken apart in pieces of about this many bytes: n-grams take a hundred times their room.
PIECE_BYTES = 1 << 18


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth row by the checksum of its id; no model learns from these."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _is_letter(codes: np.ndarray) -> np.ndarray:
    return resident("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))[codes]


def gram_buckets(data: bytes, offsets: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of all character n-grams of each text: lower case, other characters than letters as one space."""
    raw = data.replace(b"\0", b" ")
    joined = "\0".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])).lower() + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    breaks = codes == 0
    letter = _is_letter(codes)
    codes[~letter & ~breaks] = 32
    kept = letter | breaks
    kept[1:] |= codes[1:] != codes[:-1]
    codes = codes[kept].astype(np.uint64)
    breaks = codes == 0
    text = np.cumsum(breaks) - breaks
    found, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        inside = ~breaks[: len(codes) - n + 1]
        for j in range(1, n):
            inside &= ~breaks[j : len(codes) - n + 1 + j]
        mixed = np.zeros(int(inside.sum()), np.uint64)
        for j in range(n):
            mixed = mixed * np.uint64(0x100000001B3) + codes[j : len(codes) - n + 1 + j][inside]
        found.append((mix64(mixed + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(text[: len(codes) - n + 1][inside])
    cuts = [np.searchsorted(o, np.arange(len(offsets))) for o in owners]
    return [np.concatenate([f[c[i] : c[i + 1]] for f, c in zip(found, cuts)]) for i in range(len(offsets) - 1)]


def counts_of(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(buckets, minlength=1 << BUCKET_BITS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class LanguageModel:
    """Fixed-size model: weights of hash buckets for each language, inverse document frequencies, a temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    temperature: float = 1.0

    def vector(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used, counts = counts_of(buckets)
        value = (1 + np.log(counts)) * self.idf[used]
        return used, value / max(float(np.sqrt(value @ value)), 1e-12)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp((logits - logits.max()) / self.temperature)
        return e / e.sum()

    def predict(self, buckets: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        used, value = self.vector(buckets)
        p = self.probabilities(value @ self.weights[used])
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> None:
        """Follow the regularised leader over the vectors in turn; every fifth one is left for the temperature."""
        self.languages = sorted(set(labels))
        index = {c: i for i, c in enumerate(self.languages)}
        k = len(self.languages)
        z, n = np.zeros((1 << BUCKET_BITS, k)), np.zeros((1 << BUCKET_BITS, k))

        def solved(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

        rows = [(*t, index[c]) for t, c in zip(texts, labels)]
        for _ in range(epochs):
            for i, (used, value, label) in enumerate(rows):
                if i % 5 == 4:
                    continue
                zs, ns = z[used], n[used]
                w = solved(zs, ns)
                logits = value @ w
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[label] -= 1
                gradient = np.outer(value, error)
                grown = ns + gradient * gradient
                z[used] = zs + gradient - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
                n[used] = grown
        self.weights = solved(z, n)
        held = [(value @ self.weights[used], label) for used, value, label in rows[4::5]]
        if held and k > 1:
            logits, truth = np.array([h[0] for h in held]), np.array([h[1] for h in held])

            def loss(t: float) -> float:
                scaled = logits / t
                top = scaled.max(1)
                return float((top + np.log(np.exp(scaled - top[:, None]).sum(1)) - scaled[np.arange(len(truth)), truth]).mean())

            grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
            self.temperature = float(grid[np.argmin([loss(t) for t in grid])])


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and the number of rows; a task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in words.pieces(batch, "text", PIECE_BYTES):
                for buckets in gram_buckets(data.tobytes(), offsets):
                    seen[np.bincount(buckets, minlength=1 << BUCKET_BITS) > 0] += 1
                    total += 1
        used = np.flatnonzero(seen)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[seen[used], total])], names=["bucket", "n"])

    df, total = np.zeros(1 << BUCKET_BITS), 0
    for r in rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    return df, total


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAINING_ROWS) -> LanguageModel:
    """Fit on labelled rows that are not held out.

    Document frequencies cover all of them.  The classifier is fitted on a sample by the text's hash of
    ``rows`` in the mean at most, in one task, in the order of that hash, so a rerun gives the same model; copies
    of a text with one label are drawn once, and only the sample leaves the tasks that scan.
    No labelled row at all gives a model that knows no language.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter(
        F.col("text").isNotNull() & F.col("label").isNotNull() & ~held_out("id")
    )
    df, total = _document_frequencies(labelled)
    model = LanguageModel(idf=np.log((1 + total) / (1 + df)) + 1)
    if not total:
        return model
    share = min(1.0, rows / total)
    draw = F.xxhash64(F.lit("language"), "text")
    sample = labelled.select("text", "label", draw.alias("draw")).filter(F.shiftrightunsigned("draw", 12) < F.lit(int(share * (1 << 52))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for at, to, data, offsets in words.pieces(batch, "text", PIECE_BYTES):
                # a vector takes a tenth of the room of its text's n-grams
                vectors = [(used.astype(np.uint16), value) for used, value in map(model.vector, gram_buckets(data.tobytes(), offsets))]
                found += zip(batch.column("draw")[at:to].to_pylist(), batch.column("label")[at:to].to_pylist(), vectors)
        found.sort(key=lambda x: (x[0], x[1]))
        if found:
            model.fit([x[2] for x in found], [x[1] for x in found])
            blob = model.weights.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.languages], pa.list_(pa.string())), pa.array([blob], pa.binary()), pa.array([model.temperature])],
                names=["languages", "weights", "temperature"],
            )

    fitted = sample.dropDuplicates(["draw", "label"]).repartition(1).mapInArrow(fit, "languages array<string>, weights binary, temperature double").collect()
    for r in fitted:
        model.languages, model.temperature = list(r.languages), r.temperature
        model.weights = np.frombuffer(bytes(r.weights), "<f8").reshape(1 << BUCKET_BITS, len(model.languages))
    return model


def _verdicts(own: LanguageModel, batch: pa.RecordBatch, text_col: str) -> list[tuple[str, float]]:
    """Language and calibrated probability of each text of a batch."""
    said = []
    for _, _, data, offsets in words.pieces(batch, text_col, PIECE_BYTES):
        raw = data.tobytes()
        for i, buckets in enumerate(gram_buckets(raw, offsets)):
            letters = len(buckets) > 0 and has_letter(raw[offsets[i] : offsets[i + 1]])
            said.append(own.predict(buckets) if letters else (UNKNOWN, 0.0))
    return said


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with __lang_pred and __lang_score (the calibrated probability).

    Whole texts are judged, from their characters only.  Defined cases: a null text, or one without a letter,
    is ``und`` with score 0, and so is every text if the model knows no language; repeated rows are judged
    alike; an empty table gives no rows; extra columns named like the two that are added are replaced by them.
    """
    docs = docs.drop("__lang_pred", "__lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__lang_score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = _verdicts(shared.value, batch, text_col)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=[*batch.schema.names, "__lang_pred", "__lang_score"],
            )

    return docs.mapInArrow(judge, schema)


def in_a_language(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model knows with at least this probability, with all columns whatever their names.

    Rejected rows don't return from the tasks' Python workers.  Defined cases: as ``identify``; ``und`` never stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [name != UNKNOWN and score >= least for name, score in _verdicts(shared.value, batch, text_col)]
            yield batch if all(stays) else batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
