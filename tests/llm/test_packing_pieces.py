"""Pieces of letters and digits alone are not searched for places to cut; the ids are those of the plain tokenizer."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from tallyspark.llm import packing


def test_only_pieces_with_signs_are_searched(monkeypatch):
    searched, parts = [], packing._PARTS

    class Seen:
        @staticmethod
        def split(p):
            searched.append(p)
            return parts.split(p)

    monkeypatch.setattr(packing, "_PARTS", Seen)
    texts = ["oak table, oak chair", "a\nline and a\n\nline. 42 x2", "", "Tür größe naïve  two\tspaces", "oak, table", "\nlead  . x,y  é"] * 2
    encode = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")), remember=5)
    for _ in range(3):  # the second and third time pieces come from either generation
        ids, at = encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert np.array_equal(ids[at[k] : at[k + 1]], encode.tokenizer.encode(t, add_special_tokens=False).ids)
    assert searched and not any(p.strip(" ").isalnum() for p in searched)
