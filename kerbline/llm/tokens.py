"""Token counts of whole texts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kerbline.llm import words

#: A worker forgets the words it has seen when it holds this many; results don't depend on it.
REMEMBERED = 600_000
MERGE_BATCH = 50_000
NEVER = np.int64(1 << 40)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: visible Latin-1 ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class RankMerger:
    """Counts tokens as the public tokenizer file at ``path`` has them: pairs merge in the order of their ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        vocab, merges, ending = model["vocab"], model["merges"], model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        # symbol of each byte inside a word, and at a word's end
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + ending] for c in chars], np.int64)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int64)
        # where a product can at once take part in an earlier merge, only the leftmost place may merge in a round
        soonest = np.full(max(vocab.values()) + 1, NEVER)
        ranks = np.arange(len(pairs), dtype=np.int64)
        np.minimum.at(soonest, left, ranks)
        np.minimum.at(soonest, right, ranks)
        self.all_at_once = soonest[self.product] > ranks
        specials = [t["content"] for t in said["added_tokens"] if t["special"]]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        split = next(p for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.remembered: dict[bytes, int] = {}

    def ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of each symbol's pair with its right neighbour; NEVER at a sequence's end and for pairs that don't merge."""
        out = np.full(len(symbols), NEVER)
        inside = np.flatnonzero(~last[:-1])
        keys = symbols[inside] << 32 | symbols[inside + 1]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[inside] = np.where(self.keys[at] == keys, self.rank_of_key[at], NEVER)
        return out

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that are left of each byte sequence when no pair can merge any more."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        left = np.ones(len(sequences), np.int64)
        live = np.flatnonzero(lengths > 1)  # sequences still merging
        data = np.frombuffer(b"".join([sequences[i] for i in live]), np.uint8)
        size = lengths[live]
        last = np.zeros(len(data), bool)
        last[np.cumsum(size) - 1] = True
        symbols = np.where(last, self.final[data], self.inner[data])
        while len(live):
            rank = self.ranks(symbols, last)
            starts = np.cumsum(size) - size
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            left[live[done]] = size[done]
            of = np.repeat(np.arange(len(live)), size)
            hit = (rank == lowest[of]) & (rank < NEVER)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # overlapping places (a run of one symbol) merge from the left, every second one
            run_start = np.r_[True, np.diff(at) > 1]
            first_of_run = np.maximum.accumulate(np.where(run_start, at, 0))
            take = (at - first_of_run) % 2 == 0
            leftmost = np.r_[True, np.diff(of[at]) > 0]
            take &= self.all_at_once[rank[at]] | leftmost
            at = at[take]
            symbols[at] = self.product[rank[at]]
            last[at] = last[at + 1]
            keep = ~done[of]
            keep[at + 1] = False
            size = np.bincount(of[keep], minlength=len(live))[~done]
            live = live[~done]
            symbols, last = symbols[keep], last[keep]
        return left

    def pre_tokens(self, word: bytes) -> tuple[list[bytes], int]:
        """A word's pre-tokens in bytes, and how many special tokens stand in it."""
        text = word.decode("utf-8")
        if text.isascii() and text.isalpha():
            return [word.lower()], 0
        parts, special = [text], 0
        if self.special and "<" in text:
            parts = self.special.split(text)
            special = len(parts) // 2
            parts = parts[::2]
        out = []
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            out += [t.encode() for t in ([part] if part.isalpha() else self.pattern.findall(part))]
        return out, special

    def learn(self, unseen: Iterable[bytes]) -> None:
        unseen = list(unseen)
        for at in range(0, len(unseen), MERGE_BATCH):
            some, sequences, owner = unseen[at : at + MERGE_BATCH], [], []
            counts = np.zeros(len(some), np.int64)
            for i, word in enumerate(some):
                found, counts[i] = self.pre_tokens(word)
                sequences += found
                owner += [i] * len(found)
            if sequences:
                np.add.at(counts, np.array(owner), self.surviving(sequences))
            self.remembered.update(zip(some, counts.tolist()))

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each whole text."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        split = [t.split() for t in texts]  # bytes split at the six ASCII spaces, which no token crosses
        self.learn(set().union(*split).difference(self.remembered))
        known = self.remembered.__getitem__
        return [sum(map(known, s)) for s in split]


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One merger per worker and file."""
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every whole text.

    ``tokenizer`` is the path of a byte-level BPE file with word ends, readable by every worker.  No shuffle; a
    worker holds about a megabyte of text and a bounded memory of words at a time.

    Defined cases: a null text counts as an empty one, with no tokens; rows are judged one by one, so repeated
    rows and null ids pass; an empty table gives no rows; other columns are ignored.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = merger(tokenizer)
        for batch in batches:
            size, tokens = [], []
            for _, _, data, offsets in words.pieces(batch, "text"):
                raw = data.tobytes()
                tokens += made.count([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
                size += np.diff(offsets).tolist()
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(count, schema)
