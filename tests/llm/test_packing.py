import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cohortlake.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = P.Encoder(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab 'st\n\t\r0é<|>1ß¿×·\u00a0ſ…–"), st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "I'LL don't", " \u2028 x", "１２3", "e\u0301"])))
def test_ids_are_those_of_tokenizers(text):
    assert ENCODER.encode([text])[0].tolist() == ids_of(text)[:-1]


def test_the_fast_way_is_taken():
    assert ENCODER.fast is not None and P._PLAIN.fullmatch("Größe, “naïve” – d'été\n") and not P._PLAIN.fullmatch("日本")


def check(rows, docs, window, padding=None):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(ids_of(t))
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        if len(want[d]) > 1:  # repeated ids: as many pieces as the rows have ids
            assert sum(r["length"] for r in own) == sum(map(len, want[d]))
            continue
        ids, at = np.array(want[d][0], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    if padding:
        used = [sum(r["length"] for r in own) for own in sequences.values()]
        assert 1 - sum(used) / (window * len(used)) <= padding


def test_the_table(documents):
    rows = P.pack(documents, with_ids=False).collect()
    check(rows, [tuple(r) for r in documents.select("doc_id", "text").collect()], 1024, padding=0.03)


def test_many_windows_and_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "MERGE_IDS", 50)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(P.pack(df, window=32, open_windows=4).collect(), docs, 32)


def test_hard_rows(spark, hard_docs):
    docs = [tuple(r) for r in hard_docs.select("doc_id", "text").collect()]
    pieces = P.pack(hard_docs, window=64)
    check(pieces.collect(), docs, 64)
    whole = P.sequences(pieces, 64, pad_id=50256).collect()
    assert sum(r["n_ids"] for r in whole) == sum(len(ids_of(t)) for _, t in docs)
    assert all(len(r["ids"]) == 64 and r["ids"][r["n_ids"] :] == [50256] * (64 - r["n_ids"]) for r in whole)


def test_empty_table(no_docs):
    assert P.pack(no_docs).count() == 0


def test_best_fit_and_fullest(spark):
    """Lengths 5, 4, 3, 2, 4 (with the end id): 3 fills the first window, 2 joins the second, and 4 takes the place
    of the full one; the leftovers, 4 and 4 + 2, are laid on end."""
    docs = [(i, " a" * (n - 1)) for i, n in enumerate([5, 4, 3, 2, 4])]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), window=8, open_windows=2).collect()
    together = {}
    for r in rows:
        together.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["length"]))
    assert sorted(sorted(x) for x in together.values()) == [[(0, 0, 5), (2, 0, 3)], [(1, 0, 4), (4, 0, 4)], [(3, 0, 2)]]
    with pytest.raises(StopIteration):
        next(P._Rows(False).batches())
