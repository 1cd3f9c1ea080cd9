"""The pipeline's stages on rows that are hard for them, on empty tables and under names that they use themselves."""

from collections import Counter

import pytest
from test_corpus import near_texts, plain_components

from formline.llm import op2_pieces as op2
from formline.llm import op5_jaccard as op5
from formline.llm import pipeline

NAMES = ["row", "_id", "_own", "r1", "r2", "f1", "component", "kept", "times", "epochs", "taken", "source_size", "_m_key", "c0", "s_n_words", "d", "h", "own", "spans"]


@pytest.fixture
def clashing(hard):
    long = " ".join(f"word{k}" for k in range(80))
    more = hard.sparkSession.createDataFrame([(50, long, "s1"), (50, long + " x", "s1"), (51, long, "s2"), (None, long, "s2"), (None, long, "s2"), (50, long, "s1")], "doc_id long, text string, source string")
    more = more.selectExpr("doc_id", "text", "'en' lang", "source", "length(text) n_chars", "1 size", "2 shard", "3 kept", "4 score", "5 t", "6 n", "7 c", "8 base", "9 label", "10 target")
    return hard.unionByName(more).selectExpr("*", *[f"'own {c}' AS `{c}`" for c in NAMES if c != "kept"])


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, clashing, k):
    _, stage = pipeline.STAGES[k]
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows
    own = [c for c in clashing.columns if c not in ("text", "n_chars")]
    before = {tuple(r[c] for c in own) for r in clashing.collect()}
    assert {tuple(r[c] for c in own) for r in rows} <= before
    assert stage(spark, clashing.limit(0), "").count() == 0


def test_last_stage(spark, clashing):
    _, stage = pipeline.STAGES[4]
    rows = stage(spark, clashing, "").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in clashing.collect()}
    texts = {(r["doc_id"], r["text"] or "") for r in clashing.collect()}
    back = {(r["doc_id"], r["text"]) for r in op2.decode(stage(spark, clashing, "")).collect()}
    assert back == texts
    assert stage(spark, clashing.limit(0), "").count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_one_of_each(spark, monkeypatch, clashing, few):
    """Copies and near copies leave one row; rows of one doc_id with other texts and all rows without words stay."""
    monkeypatch.setattr(op5, "BROADCAST_ROWS", few)
    got = Counter((r["doc_id"], (r["text"] or "")[:20] if r["text"] is None or len(r["text"]) < 10_000 else "long") for r in op5.one_of_each(clashing).collect())
    letters = "a b c d e f g h i j k l m n o p"
    # one of the rows of doc_id 50 stands for all of its near copies
    assert got == Counter([(1, letters[:20]), (3, ""), (4, ""), (5, "   \n\t "), (6, "long"), (8, "é ñ 漢字 🙂\xa0x"), (-9, "one"), (10, "token: abcdefgh1234 "), (50, "word0 word1 word2 wo")])


def test_one_of_each_against_all_pairs(spark):
    rows = near_texts(150, 8) + [(1003, ""), (1004, None)]
    rows += [(rows[0][0], "quite another text under a doc_id that another row has as well"), (rows[1][0], rows[1][1])]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    group = {i: c for i, (c, _) in plain_components(numbered).items()}
    best = {}
    for i, (doc_id, text) in enumerate(rows):
        best.setdefault(group[i], []).append(doc_id)
    got = Counter(r["doc_id"] for r in op5.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(min(some) for some in best.values())
