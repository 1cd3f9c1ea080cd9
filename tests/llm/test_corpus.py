"""Operators 1, 5, 6, 8 and 10 and the pipeline against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from formline.llm import op1_quality as op1
from formline.llm import op5_jaccard as op5
from formline.llm import op6_classifier as op6
from formline.llm import op8_transport as op8
from formline.llm import op10_substrings as op10
from formline.llm.components import components


def plain_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t*|\x0b\x1c ", max_size=60))
def test_statistics(text):
    assert op1.statistics(text.encode())[:5] == plain_base(text)


def test_quality(spark, sf_dir, texts):
    rows = op1.op1_quality(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = op1.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


def test_label_model_finds_good_rules():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where((rng.random(4000) < acc) == truth, 1, -1)) for acc in (0.95, 0.9, 0.85, 0.6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, p = op1.fit(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.08
    accuracy = [p[1, r, 1] for r in range(4)]
    assert accuracy[0] > accuracy[3] and accuracy[1] > accuracy[3]
    assert op1.fit(np.zeros((0, 4)), np.zeros(0))[0] == 0.5


def test_quality_filter_of_hard_rows(spark, hard):
    out = op1.filter_quality(hard)
    assert out.columns == hard.columns
    assert {r["doc_id"] for r in out.collect()} <= {6, 7}
    assert op1.filter_quality(hard.limit(0)).count() == 0


def plain_sets(rows):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().translate(low).split()
        out.append((doc_id, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (find(d), len(s)) for d, s in sets}


def near_texts(n, seed, words=60):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = [f"w{x}" for x in rng.integers(0, 400, words + int(rng.integers(0, 20)))]
        for _ in range(int(rng.integers(1, 8))):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, 4))):
                text[at] = f"x{rng.integers(0, 9)}"
            out.append(" ".join(text))
    return [(int(i), t) for i, t in zip(rng.permutation(n), out[:n], strict=True)]


@pytest.mark.parametrize(("block", "dense"), [(1 << 22, 2), (300, 1), (300, 2)])
def test_near_duplicates(spark, monkeypatch, block, dense):
    """Small blocks make groups of many; links across blocks must not be lost."""
    monkeypatch.setattr(op5, "BLOCK", block)
    monkeypatch.setattr(op5, "BITMAP_BLOCK", block)
    monkeypatch.setattr(op5, "DENSE", dense)
    rows = near_texts(120, 3) + [(1000, "a b"), (1001, "A b"), (1002, "a b c"), (1003, ""), (1004, None)]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in op5.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(0, 40))
def test_trees_find_all_components(seed, n, m):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2))

    def some(k):
        out = []
        for _ in range(k):
            s = base[rng.random(len(base)) < rng.choice([0.5, 0.85, 0.95])]
            out.append(np.unique(np.append(s, rng.integers(0, 2**63, 1).astype(np.uint64))))
        return sorted(out, key=len)

    a, b = some(n), some(m) if m else None
    other = a if b is None else b
    want, have = op5.Groups(n + m), op5.Groups(n + m)
    true = set()
    for i, x in enumerate(a):
        for j, y in enumerate(other):
            if b is None and i >= j:
                continue
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                true.add((i, j))
                want.join(i, j + (0 if b is None else n))
    found = op5.linked(a, b)
    assert set(found) <= true
    for i, j in found:
        have.join(i, j + (0 if b is None else n))
    assert [want.find(k) for k in range(n + m)] == [have.find(k) for k in range(n + m)]


def test_near_duplicates_of_hard_rows(spark, hard):
    got = [(r["doc_id"], r["component_id"]) for r in op5.near_duplicates(hard).collect()]
    assert len(got) == hard.count()
    assert dict(g for g in got if g[0] is not None) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, -9: -9, 10: 10}
    assert (None, 1) in got
    assert op5.near_duplicates(hard.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removals(rows):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone |= set(range(k, k + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def repeats(seed, n=80):
    rng = np.random.default_rng(seed)
    passages = [[f"p{i}_{k % 40}" for k in range(int(rng.integers(10, 70)))] for i in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(int(rng.integers(0, 5))):
            text += [f"u{x}" for x in rng.integers(0, 30, int(rng.integers(0, 25)))]
            p = passages[rng.integers(0, len(passages))]
            a = int(rng.integers(0, len(p)))
            text += p[a:]
        rows.append((int(rng.integers(-50, 50)) if i % 9 == 0 else i, " ".join(text)))
    return rows + [(500, rows[0][1]), (501, rows[1][1]), (501, rows[1][1])]


@pytest.mark.parametrize(("batch", "hot", "together"), [(10_000, 1 << 18, 1 << 19), (3, 4, 1 << 19), (3, 2, 50)])
def test_substrings(spark, monkeypatch, batch, hot, together):
    """Batches of three rows cut runs of one minimiser anywhere; many minimisers are hot, and tasks see few runs together."""
    monkeypatch.setattr(op10, "HOT_RUNS", hot)
    monkeypatch.setattr(op10, "TOGETHER", together)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = repeats(batch)
        got = sorted(tuple(r) for r in op10.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted(plain_removals(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_substrings_of_hard_rows(spark, hard):
    got = Counter(tuple(r) for r in op10.remove_repeats(hard).collect())
    assert got == Counter(plain_removals([(r["doc_id"], r["text"]) for r in hard.collect()]))
    assert op10.remove_repeats(hard.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=30), min_size=1, max_size=8), st.integers(1, 6))
def test_index_against_search(contents, most):
    text = np.concatenate([np.append(np.array(c) + 1, 0) for c in contents])
    index = op10.FmIndex(text)
    low, high, length = index.statistics(text, most)
    ring = text.tolist()
    for k in range(len(text) - most + 1):
        want = ring[k : k + most]
        if 0 in want:
            assert length[k] < most
            continue
        places = {i for i in range(len(ring) - most + 1) if ring[i : i + most] == want}
        assert length[k] == most
        assert set(index.suffixes[low[k] : high[k]].tolist()) == places


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = op6.op6_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_classifier_reruns_and_hard_rows(spark, hard):
    rows = hard.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label"))
    w = op6.train(rows, bits=12)
    assert (w == op6.train(rows.repartition(3), bits=12)).all()
    scores = op6.score(hard, w, bits=12).collect()
    assert len(scores) == hard.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert not op6.train(rows.limit(0), bits=12).any()


def test_transport_round_trip(spark, sf_dir, texts, hard):
    rows = op8.op8_transport(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = op8.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] % 188 == 0 and r["feature"].endswith("errors=0")
    got = op8.decode(op8.encode(hard)).collect()
    assert Counter((r["doc_id"], bytes(r["payload"])) for r in got) == Counter((r["doc_id"], op8.padded((r["text"] or "").encode())) for r in hard.collect())
    assert op8.decode(op8.encode(hard.limit(0))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32 - 1))
def test_streams(blocks, seed):
    payload = np.random.default_rng(seed).integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    s = op8.demux(op8.mux(payload))
    units = -(-len(payload) // op8.UNIT)
    assert s.payload == payload and s.errors == 0
    assert s.timestamps == [k * op8.TICKS for k in range(units)]
    assert s.random_access == list(range(0, units, op8.RANDOM_EVERY))


def test_damage_is_seen():
    data = op8.mux(bytes(range(256)) * 200)
    lost = data[: 188 * 20] + data[188 * 21 :]
    assert op8.demux(lost).errors >= 1
    table = bytearray(data)
    table[13] ^= 1
    assert op8.demux(bytes(table)).errors >= 1
    with pytest.raises(ValueError):
        op8.demux(data[:-1])


def test_pipeline(spark, tmp_path, hard):
    words = [f"word{k}" for k in range(3000)]
    rng = np.random.default_rng(5)
    clean = lambda: " ".join(words[i] for i in rng.integers(0, 3000, 120))
    texts = [clean() for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s1", len(texts[3])), (101, texts[4] + " more", "en", "s2", 1), (102, "### *** " * 60, "en", "s0", 1), (103, texts[5] + " token=abcdef123456", "en", "s0", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    kept = {r["doc_id"] for r in seen["quality rules"]}
    assert set(range(40)) | {100, 101, 103} == kept
    assert {r["doc_id"] for r in seen["near duplicates"]} == set(range(40))
    assert all("abcdef123456" not in r["text"] for r in seen["secrets"])
    total = sum(len(r["text"].split()) for r in seen["secrets"])
    # whole documents: each source is off by half a document at most
    assert abs(sum(len(r["text"].split()) for r in seen["mix of sources"]) - 1.5 * total) <= 3 * 61
    by = defaultdict(set)
    for r in seen["sampled segmentations"]:
        by[r["doc_id"], len(r["ids"])].add(r["sample"])
    assert {r["doc_id"] for r in seen["sampled segmentations"]} == {r["doc_id"] for r in seen["mix of sources"]}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(seen["sampled segmentations"])
