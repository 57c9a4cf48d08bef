"""Remembered pieces give the library's ids on any Unicode."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tiersift.llm.tokens import PieceEncoder

LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x400), 0x958, 0xFB1D, 0x5D0, 0x4E00,
                            0x1E9E, 0x307, 0x301, 0xAC00, 0x1100, 0x1161)] + ["İ"] * 40
MARKS = list(".,;:!?'\"-()0123456789 \n") + [" "] * 20


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_unicode_has_the_ids_of_the_library(name):
    draw, path = random.Random(21), public_tokenizers.path(name)
    encoder, library = PieceEncoder(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["ALİ.", "ALİ!", "ALİ, VELİ", "İ", "क़. שִׁ,", "ΑΣ."]
    texts += ["".join(draw.choices(LETTERS, k=draw.randrange(1, 5))) + "".join(draw.choices(LETTERS + MARKS * 4, k=draw.randrange(0, 30)))
              for _ in range(20_000)]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert raw == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_rare_words_do_not_walk_through_all_words_known():
    """Taking a set apart by the keys of a dictionary costs as much as that dictionary is long, for every batch."""
    class Counted(dict):
        walked = 0

        def __iter__(self):
            Counted.walked += 1
            return super().__iter__()

        def keys(self):
            Counted.walked += 1
            return super().keys()

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encoder, library = PieceEncoder(path), Tokenizer.from_file(path)
        encoder.known, encoder.older = Counted(), Counted()
        texts = ["Zulichber, etairele the ßauge", "the zulichber\nÉtairele Ⱥb don't a1b x's 12.5 ª", "of byonthonre" * 9]
        for text, raw in zip(texts * 2, encoder.encode(texts) + encoder.encode(texts), strict=True):
            assert raw == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert Counted.walked == 0
