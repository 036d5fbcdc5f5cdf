"""Token ids of texts by the public library, one distinct piece of text at a time; Arrow cuts, numbers and joins the pieces."""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa

from kerbline.llm import words

#: An encoder that knows more pieces of text forgets all but the first EARLY; results don't depend on it.
REMEMBERED, EARLY = 300_000, 150_000
#: Plain pieces that the library gets as one text.
TOGETHER = 1000


def _closing() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are ASCII letters or digits, and which pairs of bytes are Latin or Cyrillic letters."""
    alone, pairs = np.zeros(256, bool), np.zeros((256, 256), bool)
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        alone[c] = True
    for c in [*range(0xC0, 0x250), *range(0x400, 0x480)]:
        if chr(c).lower().isalpha():  # not the dotted I, whose lower case ends with a dot of its own
            pairs[tuple(chr(c).encode())] = True
    return alone, pairs


_ALONE, _PAIRS = _closing()


def tails(data: np.ndarray, start: np.ndarray, end: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where the run of marks begins that ends each word; the word's end if it has none, or if a token may go over its begin.

    ``marks`` says of each byte whether it is one.  The words before are non-empty and end with a letter or a digit.
    """
    last = np.maximum.accumulate(np.where(marks[data], np.int32(-1), np.arange(len(data), dtype=np.int32)))  # the last byte that is no mark
    core = last[end - 1].astype(np.int64) + 1
    inside = (core > start) & (core < end)
    before = data[np.where(inside, core, 1) - 1]
    two = np.where(inside & (core - start > 1), core, 2)
    closed = _ALONE[before] | ((core - start > 1) & _PAIRS[data[two - 2], before]) if len(data) > 1 else np.zeros(len(core), bool)
    return np.where(inside & closed, core, end)


def opened(made: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an array from ``Encoder.encode``, and where each text's begin, with the last one's end."""
    width = int(kind[2])
    places = np.frombuffer(made.buffers()[1], np.int32, len(made) + 1).astype(np.int64) // width
    return np.frombuffer(made.buffers()[2], kind, int(places[-1])), places


class Encoder:
    """Ids of whole texts by the library for the file at ``path``, with ``end`` after each text.

    A subclass cuts texts where no token goes over and nothing beside a cut changes a token; it says how many ids
    of a block of plain pieces belong to each.  Each distinct piece is encoded once as long as it is remembered.
    """

    #: The id after each text.
    end = 0

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.width = int(self.kind[2])
        self.ids: dict[bytes, bytes | None] = {}
        self.prepare(vocab)

    def prepare(self, vocab: dict[str, int]) -> None:
        """What a subclass takes from the vocabulary."""

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that count, where each piece of them starts, and the number of pieces before each text and after the last."""
        raise NotImplementedError

    def learn(self, unseen: list[bytes]) -> None:
        """Puts the ids of pieces into ``ids``; None for a piece whose text must be encoded whole."""
        raise NotImplementedError

    def alone(self, some: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece, given to the library as a text of its own."""
        found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
        return {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(some, found)}

    def together(self, some: list[bytes], joint: bytes, marked: np.ndarray, after: int) -> dict[bytes, bytes]:
        """Ids of pieces, given to the library in blocks: a block's ids are cut ``after`` places behind the marked ones, one in each piece."""
        blocks = [some[at : at + TOGETHER] for at in range(0, len(some), TOGETHER)]
        out: dict[bytes, bytes] = {}
        for block, found in zip(blocks, self.tokenizer.encode_batch_fast([joint.join(b).decode() for b in blocks], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(marked[ids]) + after
            if len(cuts) != len(block):  # not one run of letters each, after all
                out |= self.alone(block)
                continue
            blob, cuts = ids.tobytes(), (np.r_[0, cuts] if after else np.r_[cuts, len(ids)]) * self.width
            cuts = cuts.tolist()
            out.update(zip(block, [blob[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
        """Each text's ids, unsigned and little-endian, with the end id after them; ``offsets`` are the texts' places in ``data``."""
        if len(self.ids) > REMEMBERED:
            self.ids = dict(islice(self.ids.items(), EARLY))
        kept, starts, first = self.cut(data, offsets)
        places = np.append(starts, len(kept)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([p for p in own if p not in self.ids])
        ids = [*map(self.ids.__getitem__, own), np.array([self.end], self.kind).tobytes()]
        index = np.insert(pieces.indices.to_numpy(), first[1:], len(own))
        joined = pa.array(ids, pa.binary()).take(pa.array(index))
        at = np.frombuffer(joined.buffers()[1], np.int32, len(index) + 1)[first + np.arange(len(first))]
        texts = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(at.astype(np.int32)), joined.buffers()[2]])
        if not joined.null_count:
            return texts
        whole = np.unique(np.searchsorted(first[1:] + np.arange(1, len(first)), np.flatnonzero(joined.is_null().to_numpy(zero_copy_only=False)), "right"))
        said = dict(enumerate(texts.to_pylist()))
        for i in whole.tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            said[i] = self.alone([text])[text] + ids[-1]
        return pa.array(list(said.values()), pa.binary())


class WordEncoder(Encoder):
    """For the vocabulary of words: no token crosses an ASCII space, and none goes over the begin of the marks that end a word.

    Words end with an id that tells so; runs of letters, plain pieces, are one such word each.
    """

    end = 2
    MARKS = np.isin(np.arange(256), list(b".,;:!?*%$&#|()-"))

    def prepare(self, vocab: dict[str, int]) -> None:
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = words.Words(data, offsets)
        size = own.end - own.start
        place = np.r_[0, np.cumsum(size)]
        tail = tails(data, own.start, own.end, self.MARKS) if len(size) else own.end
        opens = np.zeros(place[-1] + 1, bool)
        opens[place[:-1]] = True
        opens[(place[:-1] + tail - own.start)[tail < own.end]] = True
        starts = np.flatnonzero(opens[:-1])
        return data[own.solid], starts, np.searchsorted(starts, place[own.first])

    def learn(self, unseen: list[bytes]) -> None:
        plain, others, lowered = [], [], []
        for piece in unseen:
            if piece.isalpha():
                low = piece.lower()
                lowered.append((piece, low))
                if low not in self.ids:
                    plain.append(low)
            elif not piece.isascii() and piece.decode().isalpha():
                plain.append(piece)
            else:
                others.append(piece)
        self.ids |= self.together(list(dict.fromkeys(plain)), b" ", self.ends, 1)
        self.ids.update([(piece, self.ids[low]) for piece, low in lowered])
        self.ids |= self.alone(others)


class ChunkEncoder(Encoder):
    """For the vocabulary of bytes: a space goes with the word behind it, and the marks that end a word are cut off.

    A pre-token of this vocabulary never goes on over white space.  In a run of white space before a word, all but the
    last character are one pre-token, and the last one is its own if it is no space.  Texts with white space beyond
    ASCII go to the library whole.
    """

    MARKS = np.isin(np.arange(256), list(b".,;:!?"))
    WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def prepare(self, vocab: dict[str, int]) -> None:
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = words.Words(data, offsets)
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets[:-1]] = True
        opens[own.end] = True
        if len(own.start):
            spaced = own.start[(own.start > offsets[own.doc]) & (data[own.start] != ord("<"))]  # a special token ends the text before it
            opens[spaced - 1] = True
            opens[spaced[data[spaced - 1] != 0x20]] = True
            opens[tails(data, own.start, own.end, self.MARKS)] = True
        starts = np.flatnonzero(opens[:-1])
        return data, starts, np.searchsorted(starts, offsets)

    def learn(self, unseen: list[bytes]) -> None:
        spaced, others = [], []
        for piece in unseen:
            word = piece[1:] if piece[:1] == b" " else b""
            if word.isalpha():
                spaced.append(piece)
            elif piece.isascii():
                others.append(piece)
            else:
                text = piece.decode()
                if word and text[1:].isalpha() and max(text) < "ɐ":
                    spaced.append(piece)
                elif self.WIDE_SPACE.search(text):
                    self.ids[piece] = None
                else:
                    others.append(piece)
        self.ids |= self.together(spaced, b"", self.opens, 0) | self.alone(others)
