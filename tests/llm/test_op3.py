import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formline.llm import op3_tokens as op3


def plain(text):
    if not hasattr(plain, "tok"):
        plain.tok = Tokenizer.from_file(op3.tokenizer_file())
    return [*plain.tok.encode(text or "", add_special_tokens=False).ids, 2]


def mine(text):
    if not hasattr(mine, "tok"):
        mine.tok = op3.WordTokenizer(op3.tokenizer_file(), 2)
    return np.frombuffer(mine.tok.bodies(pa.array([text]))[0].as_py(), mine.tok.kind).tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"])), st.text(alphabet="abzIS'’tsdmverl0 19.,!?*ÀÉéßñÿ×÷ªº́\n\t\x0b\x1c\x85\xa0<|>_-")))
def test_same_ids_as_the_library_over_whole_texts(text):
    assert mine(text) == plain(text)


def test_hard_texts():
    for text in ("don't x''s I'LL 'S ''s O'Reilly's", "<|endoftext|> a<|startoftext|>b <|endoftext|", "İstanbul ΑΣ σς", "é é É", "a" * 5000, "漢字 🙂", "\x01 a\x01b \x01\x01 c", "a ́b ̈"):
        assert mine(text) == plain(text), text


def test_what_is_remembered_does_not_matter(monkeypatch):
    """Generations that hold a few words, texts that share some of theirs with earlier ones."""
    monkeypatch.setattr(op3, "REMEMBERED", 5)
    monkeypatch.setattr(op3, "TOGETHER", 3)
    tok = op3.WordTokenizer(op3.tokenizer_file(), 2)
    for k in range(30):
        some = [" ".join(f"word{(k * j) % 23}x \x01{j}" for j in range(12)), "", f"Common {k} words'll"]
        assert [np.frombuffer(x, tok.kind).tolist() for x in tok.bodies(pa.array([None, *some]).slice(1)).to_pylist()] == [plain(x) for x in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_code_round_trip(values):
    control, data = op3.encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert op3.decode_values(control, data, len(values)).tolist() == values


def test_files(spark):
    rows = [(5, "b c"), (-1, "a"), (3, None), (3, "zz " * 50), (None, "x"), (9, ""), (9, "")] + [(100 + i, f"word {i} again") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, ids int")
    blocks, codebook = op3.write_tokens(df)
    got = op3.read_tokens(blocks, codebook).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(plain(r[1]), "<u2").tobytes()))
    at = 0
    for r, g in zip(ordered, sorted(got, key=lambda g: g["start"]), strict=True):
        ids = plain(r[1])
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids"]) == (r[0], at, len(ids), ids)
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    counts = codebook.orderBy("rank").limit(1).collect()
    assert counts[0]["id"] == 2  # the end id is the most frequent here
    empty = op3.write_tokens(df.limit(0))
    assert op3.read_tokens(*empty).count() == 0
