import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from auditloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_library(monkeypatch):
    library = Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    monkeypatch.setattr(packing, "CACHE", 500)  # so that the caches are emptied on the way
    mine, rng = packing.Encoder(PATH), random.Random(5)
    vocab = [w.replace("</w>", "") for w in library.get_vocab()]
    texts = ["".join(rng.choice(vocab + [" "] * 9000) for _ in range(rng.randint(1, 16))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeinthrsé' 1.\x00\x1b") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["ΑΣ İI ſ K á J̌ Å", "x<|endoftext|>y<|startoftext|>. <| <|ENDOFTEXT|>", "a" * 5000, "\x1c\x85 　!'re're a\x1cb", "I'll 'S", " </w>", "  \xa0 ", "", "TOKEN 49406"]
    for k in range(0, len(texts), 256):
        for text, (packed, ends) in zip(texts[k : k + 256], mine.encode(texts[k : k + 256])):
            ids = np.frombuffer(packed, dtype="<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
            assert all(0 < e <= len(ids) for e in ends)
