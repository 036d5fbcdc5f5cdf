"""Encoders against the library on whole texts; what workers keep; the memory of the language stage's pieces."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from kerbline.llm import common, dominance_packing, language, packing, words
from kerbline.llm.encoding import opened

PARTS = [
    "word", "Word", "WORD", "straße", "École", "éé", "Привет", "ΣΑΣ", "日本", "it's", "we'll", "'s", "a1", "12", "3.5", "x²", "é", "H̱", "́", "İ", "“q”", "foo\"", "naïve", "×", "÷", "a×", "ɐ", "​",
    ".", ",", "...", "!?", ";:", "*", "$&#", "(", ")", "-", "--", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", "\"", "\x00", "\x1c", "😀",
]
SPACES = [" ", " ", " ", " ", "", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x0c", " \t "]
WIDE = [" ", " ", "　", "\x85", "   "]


def texts() -> list[str]:
    rng = random.Random(5)
    out = ["", " ", "\n\n", ".", "a", " a", "a ", "a.", ".a", "é.", " ", " .", "é", "\n.", " ."]
    for i in range(3000):
        spaces = SPACES + WIDE if i % 10 == 0 else SPACES
        out.append("".join(rng.choice(PARTS if rng.random() < 0.6 else spaces) for _ in range(rng.randrange(1, 25))))
    return out


@pytest.mark.parametrize(("module", "file"), [(packing, "word_bpe_49k.json"), (dominance_packing, "byte_bpe_50k.json")])
def test_pieces_have_the_ids_of_whole_texts(module, file):
    made, rows = module.encoder(public_tokenizers.path(file)), texts()
    batch = pa.RecordBatch.from_arrays([pa.array([*rows, None, None], pa.string())], names=["text"])
    found = []
    for _, _, data, offsets in words.pieces(batch.slice(3), "text", 4000):
        ids, places = opened(made.encode(data, offsets), made.kind)
        found += [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])]
    whole = made.tokenizer.encode_batch([*rows[3:], "", ""], add_special_tokens=False)
    wrong = [(t, f, e.ids) for t, f, e in zip([*rows[3:], "", ""], found, whole) if f != [*e.ids, made.end]]
    assert len(found) == len(whole) and not wrong, wrong[:3]


def test_a_word_is_learnt_once_whatever_marks_end_it():
    text = " ".join(f"again{'.,;:!?'[i % 6] * (i % 5)}" for i in range(60)).encode()
    for module, file in ((packing, "word_bpe_49k.json"), (dominance_packing, "byte_bpe_50k.json")):
        made = module.encoder(public_tokenizers.path(file))
        made.ids.clear()
        made.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert sum(b"again" in piece for piece in made.ids) <= 2  # at the text's begin, and after a space


def test_workers_keep_the_state_of_one_operator():
    first = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.encoder(public_tokenizers.path("word_bpe_49k.json")) is first
    language.gram_buckets(b"letters", np.array([0, 7]))
    assert list(common._resident) == ["letters"]
    assert packing.encoder(public_tokenizers.path("word_bpe_49k.json")) is not first


def test_verdicts_and_training_take_bounded_room():
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 100] * 2000)], names=["text"])
    language.gram_buckets(b"letters", np.array([0, 7]))
    tracemalloc.start()
    language._verdicts(language.LanguageModel(), batch, "text")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6, most
