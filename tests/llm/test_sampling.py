import math
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cohortlake.llm import sampling as S
from cohortlake.llm.text import mix64
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = S.Pieces.of(PATH)


def sampled(texts, keys, k, alpha=0.5):
    lattice = S.Lattice(PIECES, texts, alpha)
    search = S.Search(lattice, mix64(np.array(keys, np.uint64)), k)
    out = []
    for j, inclusion in enumerate(search.log_inclusion()):
        ids, bounds = S.edge_ids(PIECES, lattice, *search.paths[j])
        raw, at = S.decode_ids(PIECES, ids, bounds)
        own = [tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        out.append((own, [raw[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])], search.logs[j], inclusion, search.values[j]))
    return out


def every_path(text, alpha):
    """All segmentations of a text and their probabilities, by plain recursion."""
    whole = "▁" + text.replace(" ", "▁")
    known = {MODEL.id_to_piece(i): i for i in range(MODEL.get_piece_size()) if not (MODEL.is_control(i) or MODEL.is_unknown(i) or MODEL.is_byte(i))}

    def ways(at):
        if at == len(whole):
            yield (), 0.0
            return
        steps = [((known[whole[at:to]],), PIECES.log[known[whole[at:to]]], to) for to in range(at + 1, len(whole) + 1) if whole[at:to] in known]
        if whole[at] not in known:
            raw = whole[at].encode()
            steps.append((tuple(PIECES.byte0 + b for b in raw), PIECES.byte_log * len(raw), at + 1))
        for ids, log, to in steps:
            for rest, more in ways(to):
                yield ids + rest, log * alpha + more

    paths = list(ways(0))
    total = sum(math.exp(x) for _, x in paths)
    return {p: math.exp(x) / total for p, x in paths}


TEXT = "the 🙂er\nin"


def test_probabilities_and_inclusion():
    """20,000 keys: first samples by probability, and pairs as drawn without replacement."""
    want, n = every_path(TEXT, 0.5), 20_000
    (first, _, logs, _, _), (second, _, _, _, _) = sampled([TEXT] * n, range(n), 2)
    for i in range(200):
        assert math.isclose(math.exp(logs[i]), want[first[i]], rel_tol=1e-9)
    assert all(a != b for a, b in zip(first, second))
    close = lambda count, p: abs(count - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 3
    got = Counter(first)
    assert set(got) <= set(want) and all(close(got[p], q) for p, q in want.items())
    top = sorted(want, key=want.get)[-6:]
    pairs = Counter(zip(first, second))
    assert all(close(pairs[a, b], want[a] * want[b] / (1 - want[a])) for a, b in product(top, top) if a != b)


def test_inclusion_weights_are_unbiased():
    """Dividing by inclusion probabilities estimates sums over all paths (here: 1)."""
    n, k = 4000, 3
    total = np.zeros(n)
    for _, _, logs, inclusion, _ in sampled([TEXT] * n, range(n), k):
        total += np.exp(logs - inclusion)
    assert abs(total.mean() - 1) < 5 * total.std() / math.sqrt(n)


def test_all_paths_when_k_is_large():
    want = every_path("it is", 1.0)
    found = sampled(["it is", ""], [4, 5], len(want) + 3, alpha=1.0)
    own = [f[0][0] for f in found if np.isfinite(f[4][0])]
    assert sorted(own) == sorted(want) and all(f[3][0] == 0 for f in found[: len(want)])
    values = [f[4][0] for f in found[: len(want)]]
    assert values == sorted(values, reverse=True)
    assert sum(np.isfinite(f[4][1]) for f in found) == 1 and found[0][0][1] == ()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁")), st.text(alphabet="the in\n\tgé🙂"))))
def test_samples_decode_to_their_texts(texts):
    if not texts:
        return
    for own, decoded, _, inclusion, values in sampled(texts, range(len(texts)), 3):
        for t, ids, back, x, v in zip(texts, own, decoded, inclusion, values):
            if np.isfinite(v):
                assert back == t and MODEL.decode(list(ids)) == t and x <= 0


def test_results_do_not_depend_on_the_batch():
    texts, keys = ["the inner thing is", "Eauouon. Enpaeux leaux", TEXT, "a" * 300], [1, 2, 3, 4]
    together = sampled(texts, keys, 3)
    for i in range(4):
        alone = sampled([texts[i]], [keys[i]], 3)
        assert [f[0][0] for f in alone] == [f[0][i] for f in together]


@pytest.fixture(scope="module")
def rows(hard_docs):
    return [r for r in S.decode(S.sample_encodings(hard_docs)).collect()]


def test_hard_rows(hard_docs, rows):
    texts = Counter((r["doc_id"], r["text"] or "") for r in hard_docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in rows if r["sample"] == 1) == texts
    assert all(len(r["ids"]) == 0 and r["log_inclusion"] == 0 for r in rows if r["decoded"] == "")
    assert not [r for r in rows if r["sample"] == 2 and r["decoded"] == ""]
    again = [r for r in rows if r["doc_id"] == 2]
    assert len(again) == 4 and len({bytes(r["ids"]) for r in again}) == 2


def test_partitions_do_not_matter(hard_docs, rows):
    other = S.sample_encodings(hard_docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["sample"], bytes(r["ids"]))
    assert sorted(map(key, other)) == sorted(map(key, rows))


def test_empty_table_and_broken_ids(spark, no_docs):
    assert S.sample_encodings(no_docs).count() == 0
    broken = np.array([PIECES.byte0 + 0xFF, 1, 2], "<u4").tobytes()
    df = spark.createDataFrame([(1, broken), (2, None), (3, b"")], "decoded int, ids binary")
    assert [r["_decoded"] for r in S.decode(df).orderBy("decoded").collect()] == ["�", None, ""]
