"""New words of Latin letters: once for all their cases, with the ids that the library gives whole texts."""

import random

import numpy as np
from tokenizers import Tokenizer

from tracewell.llm.tokens import ChunkEncoder, default_path

WORD = default_path("word_bpe_49k.json")


def test_cases_of_a_word_are_encoded_once(monkeypatch):
    encoder, asked = ChunkEncoder(WORD), []
    together = encoder._together
    monkeypatch.setattr(encoder, "_together", lambda words: asked.extend(words) or together(words))
    encoder.encode("Thérendion thérendion, THÉRENDION thonwhre")
    encoder.encode("Thonwhre Thérendion")
    assert sorted(asked) == ["thonwhre", "thérendion"]


def test_latin_and_other_texts_as_the_library():
    rng, library, encoder = random.Random(5), Tokenizer.from_file(WORD), ChunkEncoder(WORD)
    library.encode_special_tokens = True
    latin = [chr(i) for i in range(256)]
    for alphabet in (latin, list("aZéÉßÿÞµªº.,'s1 \x1c\x85\xa0"), [*latin, *"İΣσςΆſKǺ̀ǅŸ中😀 "]):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
