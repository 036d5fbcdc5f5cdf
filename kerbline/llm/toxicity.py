"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks, from labelled texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm import words
from kerbline.llm.language import held_out

#: Common subsequences of three letters count, less by DECAY for every letter that they span, up to SPAN letters.
DECAY, SPAN = 0.6, 9
#: A longer unbroken word is read in overlapping parts of this length.
PART = 24
CODES = 1 << 15
LANDMARKS = 320
#: Labelled texts of each class (in the mean, by the id's hash) that the machine is fitted on.
TRAINING_ROWS = 3000
ROUNDS = 8
#: Value of what holds no word of three letters: that of a clean word.
SILENT = -1.0
#: A worker forgets the words it has scored when it holds this many; results don't depend on it.
REMEMBERED = 600_000


def letters(word: str) -> str:
    """A word's letters in lower case: what stands between them doesn't hide it."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def units(text: bytes) -> list[bytes]:
    """What a text's sentences are compared by: its words, and runs of three or more single letters as one word."""
    own = text.split()
    if sum(map(len, own)) > 4 * len(own):  # on average longer words: still look for spelled-out ones
        singles = [i for i, w in enumerate(own) if len(w) == 1]
    else:
        singles = [i for i, w in enumerate(own) if len(w) <= 2]
    run: list[int] = []
    for i in [*singles, -1]:
        if run and i != run[-1] + 1:
            if len(run) >= 3:
                own.append(b"".join(own[j] for j in run))
            run = []
        run.append(i)
    return own


def parts_of(word: str) -> list[str]:
    if len(word) <= PART:
        return [word]
    return [word[i : i + PART] for i in range(0, len(word) - PART // 2, PART // 2)]


def _codes(same_length: list[str]) -> np.ndarray:
    """Letters as numbers below 32, after a mark for the word's start; other alphabets share the last five."""
    flat = np.frombuffer("".join(same_length).encode("utf-32-le"), np.uint32).astype(np.int64)
    plain = (flat >= 97) & (flat <= 122)
    codes = np.where(plain, flat - 96, 27 + flat % 5).reshape(len(same_length), -1)
    return np.concatenate([np.zeros((len(codes), 1), np.int64), codes], axis=1)


def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k of subsequences in a word of n letters, and their weights."""
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return i, j, k, DECAY ** (k - i + 1.0)


_place_cache: dict[int, tuple] = {}


def subsequences(same_length: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each subsequence of each word, and the weight of each place."""
    n = len(same_length[0]) + 1
    if n not in _place_cache:
        _place_cache[n] = _places(n)
    i, j, k, weight = _place_cache[n]
    c = _codes(same_length)
    return c[:, i] << 10 | c[:, j] << 5 | c[:, k], weight


def _norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself: equal subsequences add up before they are squared."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered, w = np.take_along_axis(codes, order, 1), weight[order]
    total = np.cumsum(w, axis=1)
    last = np.ones(codes.shape, bool)
    last[:, :-1] = ordered[:, 1:] != ordered[:, :-1]
    upto = np.where(last, total, 0)
    before = np.maximum.accumulate(upto, axis=1)
    before = np.concatenate([np.zeros((len(codes), 1)), before[:, :-1]], axis=1)
    return np.sqrt((np.where(last, total - before, 0) ** 2).sum(1))


def by_length(some: list[str], most: int = 4096) -> Iterator[tuple[list[int], list[str]]]:
    """Words of equal length together, in blocks; words under three letters have no subsequence."""
    groups: dict[int, list[int]] = {}
    for at, w in enumerate(some):
        if len(w) >= 3:
            groups.setdefault(len(w), []).append(at)
    for at in groups.values():
        for i in range(0, len(at), most):
            yield at[i : i + most], [some[j] for j in at[i : i + most]]


def kernel(some: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of words with landmarks."""
    table = np.zeros((CODES, len(landmarks)), np.float32)
    for at, same in by_length(landmarks):
        codes, weight = subsequences(same)
        for row, norm, j in zip(codes, _norms(codes, weight), at):
            np.add.at(table[:, j], row, (weight / norm).astype(np.float32))
    out = np.zeros((len(some), len(landmarks)))
    for at, same in by_length(some, 1024):
        codes, weight = subsequences(same)
        total = np.zeros((len(same), len(landmarks)))
        for place in range(codes.shape[1]):
            total += weight[place] * table[codes[:, place]]
        out[at] = total / _norms(codes, weight)[:, None]
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0, steps: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps on its active rows; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-4]
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost * weight[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


@dataclass
class ToxicityModel:
    """The machine, folded into one weight for each subsequence: a table of fixed size, with a bias and a logistic scale."""

    table: np.ndarray = field(default_factory=lambda: np.zeros(CODES))
    bias: float = -1.0
    slope: float = 1.0
    offset: float = 0.0
    seen: dict = field(default_factory=dict, repr=False)

    def values(self, some: list[str]) -> np.ndarray:
        """The machine's value of each word; a word under three letters says nothing."""
        out = np.full(len(some), SILENT)
        for at, same in by_length(some):
            codes, weight = subsequences(same)
            out[at] = self.bias + (self.table[codes] @ weight) / _norms(codes, weight)
        return out

    def word_values(self, new: list[bytes]) -> None:
        split = [parts_of(letters(w.decode("utf-8", "replace"))) for w in new]
        owner = np.repeat(np.arange(len(new)), [len(s) for s in split])
        value = self.values([p for s in split for p in s])
        best = np.full(len(new), SILENT)
        best[owner] = -np.inf
        np.maximum.at(best, owner, value)
        self.seen.update(zip(new, best.tolist()))

    def text_values(self, texts: list[bytes]) -> list[float]:
        """A text's value is that of its most toxic sentence, and a sentence's that of its most toxic word."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        split = [units(t) for t in texts]
        new = list(set().union(*split).difference(self.seen))
        for at in range(0, len(new), 50_000):
            self.word_values(new[at : at + 50_000])
        known = self.seen.__getitem__
        return [max(map(known, s), default=SILENT) for s in split]

    def score(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -500, 500))))

    def fit(self, texts: list[bytes], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> None:
        """Each toxic text is sure to hold one toxic word, and a clean one none: words and machine are found in turns.

        The first words are those most characteristic of toxic texts.  In a round the machine is trained on these and on each
        toxic text's most toxic word, against clean texts' words, above all those it took for toxic before.
        """
        bags = [sorted({p for w in units(t) for p in parts_of(letters(w.decode("utf-8", "replace"))) if len(p) >= 3}) for t in texts]
        y = np.array(toxic) == 1
        if y.all() or not y.any():
            self.bias, self.slope = (1.0 if y.any() else -1.0), 4.0
            return
        own = {True: Counter(), False: Counter()}
        for bag, label in zip(bags, y):
            own[bool(label)].update(bag)
        vocabulary = sorted(own[True] | own[False])
        place = {w: i for i, w in enumerate(vocabulary)}
        bags = [np.array([place[w] for w in bag], np.int64) for bag in bags]
        n1, n0 = y.sum(), (~y).sum()
        df1, df0 = (np.array([own[k][w] for w in vocabulary], float) for k in (True, False))
        share = (df1 + df0) / (n1 + n0)
        contrast = (df1 / n1 - df0 / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        # landmarks: characteristic words that differ from each other, and common words of clean texts
        leading = [vocabulary[w] for w in np.argsort(-contrast, kind="stable")[: 2 * landmarks]]
        alike, taken = kernel(leading, leading), []
        for i in range(len(leading)):
            if len(taken) < 3 * landmarks // 4 and (not taken or alike[i, taken].max() < 0.95):
                taken.append(i)
        chosen = [leading[i] for i in taken]
        common = [vocabulary[w] for w in np.argsort(-df0, kind="stable") if vocabulary[w] not in chosen]
        chosen += common[: landmarks - len(chosen)]
        values, vectors = np.linalg.eigh(kernel(chosen, chosen))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        clean_words = np.flatnonzero(df0 > 0)
        pool = set(clean_words[np.argsort(words.mix64(clean_words.astype(np.uint64)), kind="stable")[:6000]].tolist())
        pool |= {place[w] for w in common[:500]}
        current = contrast
        for _ in range(rounds):
            witnesses: Counter = Counter()
            for b, label in zip(bags, y):
                if label and len(b):
                    telling = (df0[b] == 0) & (contrast[b] >= max(5.0, 0.7 * contrast[b].max()))
                    witnesses.update({*b[telling].tolist(), int(b[np.argmax(current[b])])})
            if current is not contrast:
                pool |= {int(w) for b, label in zip(bags, y) if not label and len(b) for w in b[np.argsort(-current[b])[:3]]}
            against = sorted(pool)
            some = [*witnesses, *against]
            phi = kernel([vocabulary[w] for w in some], chosen) @ root
            x = np.concatenate([phi, np.ones((len(some), 1))], axis=1)
            label = np.r_[np.ones(len(witnesses)), -np.ones(len(against))]
            # a clean word costs by the number of clean texts that it would condemn
            weight = np.r_[np.array([*witnesses.values()]) / n1, 12 / len(against) + 8 * df0[against] / n0]
            w = squared_hinge(x, label, weight * 1000)
            self._fold(chosen, root @ w[:-1], float(w[-1]))
            current = self.values(vocabulary)
        top = np.array([current[b].max() if len(b) else SILENT for b in bags])
        self._calibrate(top, y)

    def _fold(self, landmarks: list[str], strength: np.ndarray, bias: float) -> None:
        self.table, self.bias = np.zeros(CODES), bias
        for at, same in by_length(landmarks):
            codes, weight = subsequences(same)
            for row, norm, j in zip(codes, _norms(codes, weight), at):
                np.add.at(self.table, row, strength[j] * weight / norm)

    def _calibrate(self, value: np.ndarray, y: np.ndarray) -> None:
        """Logistic scale by Newton steps, with a little ridge so that separable classes keep a finite slope."""
        x, w = np.stack([value, np.ones(len(value))], 1), np.array([1.0, 0.0])
        balance = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * len(y)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (balance * (p - y)) + 0.1 * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Fit on labelled texts that are not held out: ``rows`` of each class in the mean, by the id's hash, in one task.

    The labels of a sample's ids are bounded by ``rows``, so they may be sent to all tasks; texts are read
    once, and only the sample's reach the task that fits.  Several labels of an id count as the largest.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # one row per class
    model = ToxicityModel()
    if not counts:
        return model
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(int(min(1.0, rows / n) * (1 << 52)))).otherwise(share)
    sample = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "id"), 12) < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").filter("text is not null")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for at, to, data, offsets in words.pieces(batch, "text"):
                raw = data.tobytes()
                found += zip((raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])), batch.column("label")[at:to].to_pylist())
        found.sort()
        if found:
            made = ToxicityModel()
            made.fit([f[0] for f in found], [int(f[1] > 0) for f in found])
            numbers = np.r_[made.bias, made.slope, made.offset, made.table]
            yield pa.RecordBatch.from_arrays([pa.array([numbers.tolist()], pa.list_(pa.float64()))], names=["numbers"])

    for r in texts.select("text", "label").repartition(1).mapInArrow(fit, "numbers array<double>").collect():
        model.bias, model.slope, model.offset = r.numbers[:3]
        model.table = np.array(r.numbers[3:])
    return model


def judge(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with __toxic_score, from whole texts only.

    Defined cases: a null or empty text, or one without words of three letters, scores like a text that no word speaks against;
    without labels every text scores alike, under one half; repeated rows score alike; an empty table gives no rows;
    an extra column named __toxic_score is replaced.
    """
    docs = docs.drop("__toxic_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("__toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            said = []
            for _, _, data, offsets in words.pieces(batch, text_col):
                raw = data.tobytes()
                said += [own.score(v) for v in own.text_values([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.float64())], names=[*batch.schema.names, "__toxic_score"])

    return docs.mapInArrow(run, schema)
