"""Packing: every id in one piece, sequences gapless and within the limits."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopsignals.llm import packing
from shopsignals.llm.kernels import text_buffer
from shopsignals.llm.packing import dot_product_pack, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def texts():
    rnd = random.Random(4)
    odd = ["", None, " ", "\n\n a", "É́ é  x\t y z q", "it's we'll 1234 \U0001F600!!", "<|endoftext|> a<|startoftext|>b",
           "İİ ΣΣ Σ", "word " * 9000, "a'. it's. 's. <|endoftext|>. ab-c. X..9. ...  $5. É. a_b_ Ab,'", "x" * 3000, "a\r\nb\x0bc\x0c", "́ ́a", " ᅠᆨ 각"]
    return odd + [" ".join("".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 900)))
                  for _ in range(120)]


def test_ids_are_the_tokenizers(monkeypatch):
    tx = [t or "" for t in texts()]
    tx += ["É ÀÉÎõü ß ŸÿŒœ ×÷ a×b Straße", "\x00a \x1fb c\x7fd", "A1b2 12% ab--C", "<| a<|endoftext|>b a|b <b>", "na\u00a0no\u2003x\u0085y"]
    raw, off = text_buffer(pa.array(tx))
    want = [ids_of(t).tolist() for t in tx]
    for step, cache in ((1 << 23, 1 << 20), (200, 1 << 20), (3000, 40)):
        monkeypatch.setattr(packing, "CACHE", cache)
        packing._worker.clear()
        assert [x.tolist() for x in packing.token_ids(PATH, raw, off, step)] == want


@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAÉé' \n9.<|>s×\u0301")), max_size=30), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(tx):
    raw, off = text_buffer(pa.array(tx))
    want = TOKENIZER.encode_batch(tx, add_special_tokens=False)
    assert [x.tolist() for x in packing.token_ids(PATH, raw, off)] == [e.ids + [2] for e in want]


def test_pieces_cover_documents_once(docs):
    rows = list(enumerate(texts())) + [(0, ""), (None, "no id")]
    out = pack_documents(docs(rows, extra=True), PATH, group_size=50).collect()
    assert len({r["sequence_id"] for r in out}) > 3
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc.pop(0)) == 2
    text = dict(rows)
    for d, rs in by_doc.items():
        ids, at = ids_of(text[d]), 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_limits_hold_in_every_dimension(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(1, 900), rnd.randint(1, 6), rnd.randint(0, 300)) for i in range(700)] + [(900, None, 1, None)]
    df = spark.createDataFrame(rows, "id long, tokens long, turns int, loss long")
    lim = {"tokens": 2048, "turns": 12, "loss": 700}
    out = pack(df, ["id"], lim, 2)
    agg = out.groupBy("sequence_id").agg(*[F.sum(c).alias(c) for c in lim]).collect()
    assert out.count() == 701
    assert all(r[c] <= lim[c] for r in agg for c in lim)
    least = max(sum(r[i + 1] or 0 for r in rows) / m for i, m in enumerate(lim.values()))
    assert len(agg) <= 1.1 * least + 3


def test_padding_is_small_and_oversize_fails():
    rnd = np.random.default_rng(6)
    size = np.minimum(rnd.lognormal(6, 1, 4000).astype(int) + 1, 4096)
    bins, _ = dot_product_pack(np.stack((size, np.ones_like(size)), axis=1), np.array([4096, 256]))
    assert size.sum() / ((bins.max() + 1) * 4096) > 0.99
    with pytest.raises(ValueError):
        dot_product_pack(np.array([[5000, 1]]), np.array([4096, 256]))


def test_empty_table(docs):
    assert pack_documents(docs([]), PATH).collect() == []
