"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import cut_lineage

NEIGHBOURS = 10
#: Rows (in the mean, by the vector's hash) that partitions and classifier are fitted on.
SAMPLE_ROWS = 4096
PARTS = 16
HIDDEN = 64
#: Share of the sample's true neighbours that routing must reach; it decides how many partitions a query asks.
WANTED_RECALL = 0.98
#: Candidates and queries that meet in one task at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products: near, not exact."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Each row's k nearest other rows."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = _distances(x[at : at + 512], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(links: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cut a graph (a symmetric weight matrix) into two equal halves with few links between them."""
    n = len(links)
    scale = 1 / np.sqrt(links.sum(1) + 1e-9)
    trivial = 1 / (scale * np.linalg.norm(1 / scale))
    v = rng.standard_normal(n)
    for _ in range(60):  # second eigenvector of the normalised graph
        v -= trivial * (trivial @ v)
        v = v + scale * (links @ (scale * v))
        v /= np.linalg.norm(v)
    side = np.zeros(n, bool)
    side[np.argsort(v * scale, kind="stable")[n // 2 :]] = True
    for _ in range(12):  # swap the pairs that save most links
        across = links @ side
        gain = np.where(side, links.sum(1) - 2 * across, 2 * across - links.sum(1))
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        m = min(len(ones), len(zeros), max(1, n // 40))
        good = gain[ones[:m]] + gain[zeros[:m]] > 0
        if not good.any():
            break
        swap = int(good.sum())
        side[ones[:swap]], side[zeros[:swap]] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node: equal parts (a power of two) by halving the graph again and again."""
    rng, n = np.random.default_rng(seed), len(graph)
    links = np.zeros((n, n), np.float32)
    links[np.repeat(np.arange(n), graph.shape[1]), graph.ravel()] = 1
    links = np.maximum(links, links.T)
    label = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        for part in range(label.max() + 1):
            at = np.flatnonzero(label == part)
            label[at] = 2 * part + _halves(links[np.ix_(at, at)], rng)
    return label


@dataclass
class Router:
    """A small network from a vector to the probabilities of partitions."""

    centre: np.ndarray
    scale: float
    first: np.ndarray
    second: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self._wide((x - self.centre) / self.scale) @ self.first, 0)
        return self._wide(hidden) @ self.second

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.ones((len(x), 1))], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, parts: int, epochs: int = 60, seed: int = 3) -> Router:
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        made = cls(
            x.mean(0), float(x.std()) or 1.0, rng.standard_normal((d + 1, HIDDEN)) / np.sqrt(d + 1), rng.standard_normal((HIDDEN + 1, parts)) / np.sqrt(HIDDEN)
        )
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (made.first, made.second)]
        step = 0
        for _ in range(epochs if parts > 1 else 0):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                inner = made._wide((x[rows] - made.centre) / made.scale)
                hidden = np.maximum(inner @ made.first, 0)
                out = made._wide(hidden) @ made.second
                p = np.exp(out - out.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), label[rows]] -= 1
                p /= len(rows)
                back = (p @ made.second[:-1].T) * (hidden > 0)
                step += 1
                for w, g, m in zip((made.first, made.second), (inner.T @ back, made._wide(hidden).T @ p), moments):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    w -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + 1e-4 * w
        return made


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def learn(vectors: DataFrame, rows: int = SAMPLE_ROWS, parts: int = PARTS, neighbours: int = NEIGHBOURS) -> Router | None:
    """Partitions and router from a bounded sample of (id, vector)."""
    total = vectors.count()
    if not total:
        return None
    draw = F.xxhash64(F.lit("neighbours"), "vector")
    picked = vectors.filter(F.shiftrightunsigned(draw, 12) < F.lit(int(min(1.0, rows / total) * (1 << 52))))
    # copies of a vector share their hash, and one of them is enough
    found = picked.select("vector").distinct().toArrow().column("vector").combine_chunks()
    x = _matrix(found).astype(np.float64)
    if not len(x):
        x = np.array([vectors.first().vector], np.float64)
    x = x[np.lexsort(x.T[::-1])]
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    if parts == 1:
        return Router.fit(x, np.zeros(len(x), np.int64), 1)
    graph = neighbour_graph(x, neighbours)
    router = Router.fit(x, balanced_parts(graph, parts), parts)
    scores = router.logits(x)
    place = np.argsort(np.argsort(-scores, axis=1), axis=1)  # when a query asks each partition
    asked = np.sort(place[np.arange(len(x))[:, None], scores.argmax(1)[graph]].ravel())
    router.probes = int(asked[min(len(asked) - 1, int(WANTED_RECALL * len(asked)))]) + 1
    return router


def search(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
    sample_rows: int = SAMPLE_ROWS, parts: int = PARTS,
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest found rows.

    A bounded sample gives a neighbour graph, its balanced partitions and a classifier.  Every row is indexed in
    its most probable partition; a query asks as many partitions, most probable first, as the sample needs
    for ``WANTED_RECALL``, and more until they hold k rows.  Candidates are reranked on the original vectors in
    double precision.  Partitions of any size are cut into blocks of bounded size that meet blocks of queries.

    Of equal vectors only the k + 1 smallest ids can be in a result; a batch, then the shuffle, keeps these.

    Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
    do rows without an id or with another length than the commonest one (the larger of ties); rows that repeat an id are
    returned once, at the nearest; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    vectors = vectors.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = vectors.groupBy(F.size("vector").alias("size")).count()
    common = sizes.agg(F.max_by("size", F.struct("count", "size")).alias("size")).first().size
    out = f"query_id {kind}, vec_id {kind}, score double"
    if common is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    vectors = vectors.filter(F.size("vector") == common)
    router = learn(vectors.select("id", "vector"), sample_rows, parts, k)
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            part = shared.value.logits(x).argmax(1) if len(x) else np.zeros(0, np.int64)
            raw = np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel().tolist()
            own = batch.column("id").to_pylist()
            seen: dict[bytes, list[int]] = {}
            for i in sorted(range(len(own)), key=own.__getitem__):
                held = seen.setdefault(raw[i], [])
                if len(held) <= k and (not held or own[held[-1]] != own[i]):
                    held.append(i)
            keep = sorted(i for held in seen.values() for i in held)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[keep], pa.int32()), batch.column("id").take(at), batch.column("vector").take(at)], names=["part", "id", "vector"])

    indexed = vectors.select("id", "vector").mapInArrow(index, f"part int, id {kind}, vector array<double>").distinct()
    first = Window.partitionBy("vector").orderBy("id")
    indexed = cut_lineage(indexed.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).drop("nth"))
    n_parts = router.second.shape[1]
    held = np.zeros(n_parts, np.int64)
    for r in indexed.groupBy("part").count().collect():  # one row per partition
        held[r.part] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            if not len(x):
                continue
            order = np.argsort(-shared.value.logits(x), axis=1, kind="stable")
            enough = (np.cumsum(held[order], axis=1) <= k).sum(1) + 1
            asks = [order[i, : max(shared.value.probes, e)].tolist() for i, e in enumerate(enough)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(asks, pa.list_(pa.int32()))], names=["id", "vector", "parts"])

    queries = vectors.filter("asks").select("id", "vector").mapInArrow(route, f"id {kind}, vector array<double>, parts array<int>")
    queries = cut_lineage(queries.select("id", "vector", F.explode("parts").alias("part")))
    asked = np.zeros(n_parts, np.int64)
    for r in queries.groupBy("part").count().collect():
        asked[r.part] = r["count"]

    def blocks_of(counts: np.ndarray, size: int) -> Column:
        return F.element_at(F.array(*[F.lit(int(max(1, -(-c // size)))).cast("long") for c in counts]), F.col("part") + 1)

    left, right = blocks_of(held, BLOCK_ROWS), blocks_of(asked, QUERY_ROWS)
    candidates = indexed.withColumn("block", F.pmod(F.xxhash64("id"), left)).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), right - 1)))
    queries = queries.withColumn("ask", F.pmod(F.xxhash64("id"), right)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))

    def nearest(asking: pa.Table, there: pa.Table) -> pa.Table:
        found_q, found_v, found_d = [], [], []
        if asking.num_rows and there.num_rows:
            q, c = _matrix(asking.column("vector").combine_chunks()), _matrix(there.column("vector").combine_chunks())
            q_ids, c_ids = asking.column("id").to_pylist(), there.column("id").to_pylist()
            near = _distances(q, c)
            # all rows that rounding might still place among the k + 1 nearest
            kth = np.partition(near, min(k, near.shape[1] - 1), axis=1)[:, min(k, near.shape[1] - 1)]
            slack = 1e-9 * ((q * q).sum(1) + (c * c).sum(1).max())
            for i, q_id in enumerate(q_ids):
                some = np.flatnonzero(near[i] <= kth[i] + slack[i])
                exact = np.sqrt(((c[some] - q[i]) ** 2).sum(1))
                best = sorted((d, c_ids[j]) for d, j in zip(exact.tolist(), some) if c_ids[j] != q_id)[:k]
                found_q += [q_id] * len(best)
                found_d += [b[0] for b in best]
                found_v += [b[1] for b in best]
        id_type = asking.schema.field("id").type
        return pa.table([pa.array(found_q, id_type), pa.array(found_v, id_type), pa.array(found_d, pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["part", "ask", "block"]
    met = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(nearest, out)
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
