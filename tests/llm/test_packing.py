import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm_cases import ROWS, documents
from tokenizers import Tokenizer

from tallyspark.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def holds(rows, pieces, capacity=2048):
    """Every document's ids come back whole and every sequence is filled without gaps."""
    bins, docs = {}, {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append(p)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in rows:
        ids = ids_of(text)
        own = [p for p in docs[doc_id] if p.piece == 0][:1] + [p for p in docs[doc_id] if p.piece]
        at = 0
        for p in sorted(own, key=lambda p: p.piece):
            assert p.start == at and (p.piece == 0 or p.length == capacity)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    return len(bins)


def test_pieces_encode_like_whole_texts():
    texts = ["a  b", " lead", "trail ", "x\n y", "x \ny", "tab\tin a b", "\n", " ", "don't we'll  it's", "1 2 34 € ñandú <|endoftext|> z", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y, z <|endoftext |>", "a\n\nb c\n d", None, ""]
    texts += ["x\x0b y", "x\u3000 y", "x \u2028y z", "a\x1f b", " \u00a0", "é  é ü", "end.\nAnd, so\n\nwhat?! é,\n\t it's; x\r\ny...z !a\n.b", "a,b.c:d\ne"]
    encode = packing.Encoder(PATH, 3)
    for part in (texts[::2], texts[1::2], texts, texts[:1], [None]):
        ids, at = encode(pa.array([t or "" for t in part], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t)[:-1] for t in part]


def test_plan_fills_bins_well():
    rng = np.random.default_rng(5)
    for top in (2048, 900, 300):
        lengths = rng.integers(1, top, 4000)
        counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
        runs = packing.plan(counts)
        seen, fill = {}, {}
        for length, first, n, at, offset in runs:
            seen.setdefault(length, []).extend(range(first, first + n))
            for k in range(n):
                fill.setdefault(at + k, []).append((offset, length))
        assert all(sorted(seen[x]) == list(range(c)) for x, c in counts.items())
        for parts in fill.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 2048
        # large items bind the first case: a bin holds two of them at most
        bound = max(lengths.sum() / 2048, (lengths > 1024).sum())
        assert len(fill) <= 1.03 * bound + 1


def test_awkward_rows(spark):
    out = packing.pack_documents(documents(spark)).collect()
    assert len([r for r in out if r.doc_id == 9]) == 2
    assert holds([(r[0], r[1]) for r in ROWS], out) >= 1
    assert packing.pack_documents(documents(spark, []).where("false")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = packing.op8_best_fit_packing(spark, sf_dir).collect()
    assert holds([tuple(r) for r in docs], out) <= 1.02 * sum(r.length for r in out) / 2048 + 1
