"""Packing along a space-filling curve: like documents become neighbours, and sequences are cut off the curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import words
from kerbline.llm.common import cut_lineage, resident
from kerbline.llm.encoding import WordEncoder, opened
from kerbline.operators import ordered

SEQUENCE = 4096
END_ID = 2
DIMENSIONS = 4
BITS = 8
OUT_BYTES = 8 << 20


class CurveEncoder(WordEncoder):
    """With random signs: the projection of each hashed token to a few dimensions."""

    end = END_ID

    def prepare(self, vocab: dict[str, int]) -> None:
        super().prepare(vocab)
        self.projection = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (len(self.ends), DIMENSIONS))


def encoder(path: str) -> CurveEncoder:
    return resident(f"curve {path}", lambda: CurveEncoder(path))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits (transposed axes turned, then Gray code undone)."""
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        bit = np.uint64(1 << b)
        turn ^= np.where((x[n - 1] & bit) != 0, bit - np.uint64(1), np.uint64(0))
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | ((x[i] ^ turn) >> np.uint64(b) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(ids: np.ndarray, counts: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hilbert key of each document: the mean of its tokens' projections, scaled and cut into cells."""
    starts = np.cumsum(counts) - counts
    centre = np.add.reduceat(projection[ids], starts, axis=0, dtype=np.float64) / counts[:, None]
    cells = (np.tanh(3 * centre) + 1) / 2 * (1 << BITS)
    return hilbert_key(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1))


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (place on the curve), n (ids with the end id) and ids (unsigned, little-endian, 2 bytes each if the vocabulary allows)."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key long, n long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        for batch in batches:
            own = batch.column("id")
            for at, to, data, offsets in words.pieces(batch, "text"):
                blobs = made.encode(data, offsets)
                ids, places = opened(blobs, made.kind)
                counts = np.diff(places)
                keys = curve_keys(ids, counts, made.projection)
                yield pa.RecordBatch.from_arrays(
                    [own.slice(at, to - at), pa.array(keys), pa.array(counts), blobs],
                    names=["id", "key", "n", "ids"],
                )

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(encode, schema)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``sequence`` ids: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Documents are range-sorted by the Hilbert key of their projected token vectors, so neighbours on the curve
    share a sequence; the curve's ids are one stream, cut every ``sequence`` ids.  Only the last sequence is
    padded.  A document's place in the stream is a running total over range slices; a slice holds
    documents of any key, so many equal keys are split by id.

    Defined cases: a null text is an empty one and has the end id only; repeated rows are documents of their
    own, next to each other; a null id sorts first; an empty table gives no pieces; other columns are ignored.
    """
    made = cut_lineage(encoded(docs, tokenizer, id_col, text_col))
    placed = ordered.scan(made, ["key", "id", F.xxhash64("ids")], sums={"upto": F.col("n")}).select("id", "n", "ids", "upto")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out, held = [], [], 0
            counts, ends = batch.column("n").to_pylist(), batch.column("upto").to_pylist()
            for i, (n, upto) in enumerate(zip(counts, ends)):
                blob = batch.column("ids")[i].as_py()
                width, first = len(blob) // n, upto - n
                at = 0
                while at < n:
                    number, offset = divmod(first + at, sequence)
                    length = min(n - at, sequence - offset)
                    part = blob[at * width : (at + length) * width]
                    wide = np.frombuffer(part, f"<u{width}").astype("<u4").tobytes()
                    owner.append(i)
                    out.append((at, length, zlib.crc32(wide), n, number, offset, wide))
                    at += length
                    held += len(wide)
                if out and (held > OUT_BYTES or i == len(counts) - 1):
                    longs = [pa.array([x[k] for x in out], pa.int64()) for k in range(6)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(owner, pa.int64())), *longs, pa.array([x[6] for x in out], pa.binary())],
                        names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                    )
                    owner, out, held = [], [], 0
            pa.default_memory_pool().release_unused()

    return placed.mapInArrow(cut, schema)
