import itertools
import math
from collections import Counter

import numpy as np
import pytest

from formline.llm import op2_pieces as op2


@pytest.fixture(scope="module")
def lattices():
    return op2.Lattices(op2.Vocabulary(op2.model_file()))


def every_way(v, text):
    """All segmentations of a short text with their log-weights."""
    text = f" {text}"

    def ways(at):
        if at == len(text):
            yield (), 0.0
        for end in range(at + 1, len(text) + 1):
            hit = v.of.get(text[at:end]) or (v.spell(text[at]) if end == at + 1 else None)
            if hit:
                for rest, w in ways(end):
                    yield (hit[0], *rest), hit[1] + w

    found = dict(ways(0))
    total = math.log(sum(map(math.exp, found.values())))
    return {k: w - total for k, w in found.items()}


def test_law_of_the_samples(lattices):
    truth = every_way(lattices.v, "the in")
    n = 4000
    got = op2.sample_texts(lattices, ["the in"] * n, np.arange(n, dtype=np.uint64), 3)
    first, second = Counter(), Counter()
    for samples in got:
        ways = [tuple(x[0].tolist()) for x in samples]
        assert len(set(ways)) == 3
        values = [x[2] for x in samples]
        assert values == sorted(values, reverse=True)
        for way, x in zip(ways, samples, strict=True):
            assert x[1] == pytest.approx(truth[way], abs=1e-9)
            assert x[3] <= 0
        first[ways[0]] += 1
        second[ways[:2][0], ways[1]] += 1
    for way, logp in truth.items():
        p = math.exp(logp)
        assert abs(first[way] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    for (a, b), seen in second.items():
        p = math.exp(truth[a]) * math.exp(truth[b]) / (1 - math.exp(truth[a]))
        assert abs(seen / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3


def test_inclusion_scores_are_unbiased(lattices):
    """The sum of p / q over the sample estimates 1 (Horvitz-Thompson)."""
    n = 3000
    got = op2.sample_texts(lattices, ["hello on"] * n, np.arange(n, dtype=np.uint64), 4)
    estimates = [sum(math.exp(x[1] - x[3]) for x in samples) for samples in got]
    assert abs(np.mean(estimates) - 1) < 5 * np.std(estimates) / math.sqrt(n)


def test_few_ways_are_all_found(lattices):
    truth = every_way(lattices.v, "a b")
    (samples,) = op2.sample_texts(lattices, ["a b"], np.array([5], np.uint64), len(truth) + 3)
    assert {tuple(x[0].tolist()) for x in samples} == set(truth)
    assert all(x[3] == 0 for x in samples)


def test_decoding_gives_texts_back(lattices):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op2.model_file())
    texts = ["", " ", "  two  spaces\n\n and \t tabs", "café ñandú 漢字 🙂 ▁", "x" * 3000, "the cat sat " * 400, "\n", "a\n"]
    for text, samples in zip(texts, op2.sample_texts(lattices, texts, np.arange(len(texts), dtype=np.uint64), 3), strict=True):
        assert samples
        for ids, *_ in samples:
            ids = lattices.v.public(ids).tolist()
            assert lattices.v.decode([np.array(ids, np.int64), np.zeros(0, np.int64)]) == [text.encode(), b""]
            if "▁" not in text:
                assert sp.decode(ids) == text


def test_transitions(lattices):
    v = lattices.v
    for piece in list(v.of)[::50]:
        at = 0
        for c in piece:
            to = int(v.next(np.array([at]), np.array([ord(c)]))[0])
            assert to > 0
            at = to
        assert v.trie_piece[at] == v.of[piece][0]
    assert v.next(np.array([0, 5, 10**6]), np.array([0x10FFFF, 0x10FFFF, 97])).tolist() == [-1, -1, -1]


def test_rows(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (None, "abc"), (3, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sample string")
    out = op2.encode(df, 3)
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == {1: 6, 2: 1, None: 3, 3: 1}
    back = {(r["doc_id"], r["text"]) for r in op2.decode(out).collect()}
    assert back == {(1, "the cat sat on the mat"), (2, ""), (None, "abc"), (3, "")}
    assert op2.encode(df.limit(0)).count() == 0
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 3


def test_long_and_short_batches_agree(lattices):
    texts = ["one two three", "four five", "six"]
    keys = np.array([4, 5, 6], np.uint64)
    together = op2.sample_texts(lattices, texts, keys, 2)
    alone = list(itertools.chain.from_iterable(op2.sample_texts(op2.Lattices(lattices.v), [t], keys[i : i + 1], 2) for i, t in enumerate(texts)))
    for a, b in zip(together, alone, strict=True):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
