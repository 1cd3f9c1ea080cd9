"""Substring dedup: words that an earlier document has in the same window are removed, found with FM-indices over shards.

A window is 13 consecutive words. Its minimiser is the smallest hash among its 4-word grams, so equal windows have equal minimisers,
and the windows of a text fall into runs with one minimiser each. A run is the unit of work:

1. Texts that are equal share a key; only the smallest doc_id of each needs looking at. All runs' minimisers are sorted, and only runs
   whose minimiser occurs in two different texts or more go on. What a task finds shared by itself is dealt out evenly, with
   one notice for the others, so a minimiser that very many texts have is no task's burden.
2. The words of those runs, once for each distinct content and task with the smallest doc_id that has it, go to shards by minimiser, so
   all equal windows meet in one shard. Runs of a minimiser that more than HOT_RUNS runs have go window by window, to shards by minimiser and window.
3. A shard builds an FM-index over its contents: Burrows-Wheeler transform and a wavelet matrix of bit-packed levels with rank
   directories. All windows are streamed through it by backward search, many at a time; the matching statistic of a place is
   how many words on from there match, up to 13, and a place that reaches 13 has an interval of suffixes, whose smallest doc_id
   is that of the first document with the window.
4. Each run is joined with its content's answer; windows that an earlier document has mark their words in their text.

A content shared by any number of documents is indexed once. Windows are judged on the input, never on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import arrow_map, chunks, documents, materialize, settled, texts, type_of

WINDOW = 13
GRAM = 4
#: Words that a shard indexes, about.
SHARD_WORDS = 200_000
#: Runs of one minimiser beyond which its windows are dealt out singly.
HOT_RUNS = 1 << 18
#: Runs that a task looks at together for minimisers that it finds shared by itself; results do not depend on it.
TOGETHER = 1 << 17
#: Bytes that stand for a word in a shard: the low ones of its 64-bit hash.
_WORD_BYTES = 6


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def runs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of a text of word hashes w."""
    n = len(w) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.full(len(w) - GRAM + 1, GRAM, np.uint64)
    for k in range(GRAM):
        gram = _mix(gram * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(gram)])
    least, at = gram[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, WINDOW - GRAM + 1):
        less = gram[k : k + n] < least  # ties: the leftmost, which is the same in equal windows
        np.copyto(least, gram[k : k + n], where=less)
        at[less] = k
    at += np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return least[first], first, np.diff(np.append(first, n))


class FmIndex:
    """An FM-index over sequences of symbols 1 and up; 0 separates them. Suffixes are sorted by their first 16 symbols, which is enough for shorter patterns."""

    DEPTH = 16

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank, depth = text.astype(np.int64), 1
        while depth < self.DEPTH:
            width = int(rank.max(initial=0) + 2).bit_length()
            times = max(2, min(63 // width, -(-self.DEPTH // depth)))  # as many ranks as a key holds; two always fit
            key = np.zeros(n, np.int64)
            for k in range(times):
                after = rank[k * depth :] + 1
                key <<= width
                key[: len(after)] |= after
            self.suffixes = np.argsort(key, kind="stable")
            ordered = key[self.suffixes]
            rank = np.empty(n, np.int64)
            rank[self.suffixes] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
            depth *= times
        self.suffixes = self.suffixes.astype(np.int32 if n < 1 << 31 else np.int64)
        last = text[self.suffixes - 1].astype(np.int32)  # the transform; the text is taken as a ring
        self.n, self.levels = n, max(1, int(text.max(initial=0)).bit_length())
        counts = np.bincount(text, minlength=1 << self.levels)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.words, self.ranks, self.zeros = [], [], []
        left = last
        for level in reversed(range(self.levels)):
            bit = (left >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.uint32)]).astype(np.uint32))
            self.zeros.append(n - int(bit.sum()))
            left = np.concatenate([left[bit == 0], left[bit == 1]])
        symbols = np.arange(1 << self.levels)
        self.origin = self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place `at` of the transform comes to lie in the last level, going the symbol's way."""
        for k in range(self.levels):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][block].astype(np.int64) + np.bitwise_count(self.words[k][block] & mask)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of symbol followed by what [low, high) matches."""
        base = self.before[symbol] - self.origin[symbol]
        return base + self._descend(symbol, low), base + self._descend(symbol, high)

    def statistics(self, text: np.ndarray, most: int, starts: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text: for each place (or each of starts) the interval of its next `most` symbols (empty if fewer than `least`
        suffixes have them or they reach over a separator) and how many symbols, counted from the window's end, match."""
        starts = np.arange(max(0, len(text) - most + 1)) if starts is None else starts
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        length = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        for k in reversed(range(most)):
            symbol = text[starts[live] + k]
            if k == most - 1:
                a, b = self.before[symbol], self.before[symbol + 1]
            else:
                a, b = self.extend(symbol, low[live], high[live])
            ok = (symbol > 0) & (b - a >= least)
            low[live[~ok]] = high[live[~ok]] = 0
            live = live[ok]
            low[live], high[live] = a[ok], b[ok]
            length[live] += 1
        return low, high, length


def first_documents(contents: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """For each content (word hashes, a window's at least), the smallest document of each of its windows among all contents."""
    sizes = np.array([len(c) for c in contents])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    _, symbols = np.unique(np.concatenate(contents), return_inverse=True)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begins + sizes] = False
    text[inside] = symbols + 1
    index = FmIndex(text)
    owner = np.repeat(docs, sizes + 1)[index.suffixes]
    answer = np.repeat(docs, sizes + 1)  # a window of one suffix is nobody else's
    windows = np.zeros(len(text) + 1, np.int64)
    windows[begins] += 1
    windows[begins + sizes - WINDOW + 1] -= 1
    starts = np.flatnonzero(np.cumsum(windows[:-1]))
    for at in range(0, len(starts), 1 << 17):
        some = starts[at : at + (1 << 17)]
        low, high, length = index.statistics(text, WINDOW, some, 2)
        hit = np.flatnonzero(length == WINDOW)
        if len(hit):
            ends, back = np.unique(np.stack([low[hit], high[hit]], axis=1), axis=0, return_inverse=True)
            # intervals of windows of one length are equal or apart
            least = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), ends.reshape(-1))[::2]
            answer[some[hit]] = least[back.reshape(-1)]
    return [answer[b : b + n - WINDOW + 1] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


#: What a row of runs is to _shared(), in the low bits of `at`: a run, a notice that two texts share its minimiser, a run of such a minimiser.
_RUN, _NOTICE, _KNOWN = 0, 1, 2


def _minimisers(docs: DataFrame) -> DataFrame:
    """(h, t, at) of all runs of docs(text, t), of a text that a task meets again but the first time; at holds first window, number of windows and kind."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, t, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((t, h))
            h, t, at = h[order], t[order], at[order]
            begins = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            ends = np.append(begins[1:], len(h))
            many = t[begins] != t[ends - 1]
            kind = np.repeat(np.where(many, _KNOWN, _RUN), ends - begins)
            first = begins[many]
            at, notice = at << 2 | kind, at[first] << 2 | _NOTICE
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((h, h[first]), (t, t[first]), (at, notice))], names=["h", "t", "at"])

        for batch in it:
            for piece in chunks(batch):
                for t, raw in zip(piece.column("t").to_pylist(), texts(piece), strict=True):
                    if t in met:
                        continue
                    if len(met) >= TOGETHER:
                        met.clear()
                    met.add(t)
                    h, first, n = runs(word_hashes(raw.split()))
                    held.append((h.view(np.int64), np.full(len(h), t, np.int64), first << 8 | n))
                    size += len(h)
                if size >= TOGETHER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text", "t").mapInArrow(settled(f), "h long, t long, at long")


def _shared(rows: DataFrame) -> DataFrame:
    """The runs among rows(h, t, at) whose h two different t or more have: h, t, first, n. A run that two tasks have sent may come twice.

    Streamed in order of h and t: of an h, only the rows of its first t are held until another t or a notice comes. Runs that are known to be
    shared go where their h and t lead, all others and the notices where h does.
    """

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the current h and its first t
        now, sure = None, False
        for batch in it:
            x = np.stack([batch.column(c).to_numpy() for c in ("h", "t", "at")], axis=1)
            if not len(x):
                continue
            begins = np.concatenate([[0], np.flatnonzero(np.diff(x[:, 0])) + 1])
            ends = np.append(begins[1:], len(x))
            many = (x[begins, 1] != x[ends - 1, 1]) | np.logical_or.reduceat(x[:, 2] & 3 > 0, begins)
            if now is not None and x[0, 0] == now:
                many[0] |= sure or held[0][0, 1] != x[0, 1]
                if many[0] and held:
                    yield from send(np.concatenate(held))
                    held = []
            else:
                held, sure = [], False
            keep = np.repeat(many, ends - begins)
            if keep.any():
                yield from send(x[keep])
            if not many[-1]:
                rest = x[begins[-1] :]
                held = [np.unique(np.concatenate([*(held if len(begins) == 1 else []), rest]), axis=0)]
            else:
                held = []
            now, sure = x[-1, 0], bool(many[-1])

    def send(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = x[x[:, 2] & 3 != _NOTICE]
        x[:, 2] >>= 2
        x = x[np.append(True, (np.diff(x, axis=0) != 0).any(axis=1))] if len(x) else x
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array((x[:, 2] >> 8).astype(np.int32)), pa.array((x[:, 2] & 255).astype(np.int32))], names=["h", "t", "first", "n"])

    where = F.when(F.col("at").bitwiseAND(3) == _KNOWN, F.xxhash64("h", "t")).otherwise(F.xxhash64("h"))
    return rows.repartition(where).sortWithinPartitions("h", "t", "at").mapInArrow(settled(f), "h long, t long, first int, n int")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with its text's keys t and t2, removals(r_id, r_t, r_t2, whole, starts)): starts are the removed windows' first words; whole texts are copies.

    Two 64-bit hashes tell texts apart where a copy loses all its words; one does for runs, whose words are compared anyway.
    """
    keyed = docs.withColumns({"t": F.xxhash64("text"), "t2": F.xxhash64(F.lit(WINDOW), "text")})
    shared = materialize(_shared(_minimisers(keyed.where("text is not null").select("text", "t"))), "op10-runs")
    keys = materialize(keyed.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "t", "t2"), "op10-keys")
    firsts = keys.groupBy("t", "t2").agg(F.min("id").alias("m"))
    hot = shared.groupBy(F.col("h").alias("hot")).agg(F.ceil(F.count("*") / HOT_RUNS).cast("int").alias("parts")).where("parts > 1")
    hot = materialize(hot, "op10-hot")
    if hot.isEmpty():
        of_text = shared.withColumn("parts", F.lit(1))
    else:
        of_text = shared.join(hot, F.col("h") == F.col("hot"), "left").select("t", "h", "first", "n", F.coalesce("parts", F.lit(1)).alias("parts"))
    # a run may have come from two tasks
    of_text = of_text.groupBy("t").agg(F.collect_set(F.struct("h", "first", "n", "parts")).alias("runs"))
    of_text = of_text.join(firsts, "t").select(F.col("m").alias("r_id"), F.col("t").alias("r_t"), F.col("t2").alias("r_t2"), "runs")
    shards = max(1, shared.count() * (WINDOW + 4) // 2 // SHARD_WORDS)
    here = (F.col("doc_id") == F.col("r_id")) & (F.col("t") == F.col("r_t")) & (F.col("t2") == F.col("r_t2"))
    # rows without runs stay, so that this join and the last one share one exchange of the texts
    mine = keyed.join(of_text, here, "left").select("doc_id", "text", "t", "t2", "runs")

    def contents(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int], list[bytes], list[int]]]:
        """Of each row its number, and of its pieces (runs, or windows of hot minimisers' runs) h, first word, content and shard."""
        column = batch.column("runs")
        cuts, rows = column.offsets.to_numpy().tolist(), column.values.field
        all_h, all_first, all_n, all_parts = (rows(c).to_numpy() for c in range(4))
        for i, raw in enumerate(texts(batch)):
            if cuts[i] == cuts[i + 1]:
                continue
            h, first, n, parts = (x[cuts[i] : cuts[i + 1]] for x in (all_h, all_first, all_n, all_parts))
            if (many := parts > 1).any():
                wide = np.repeat(np.arange(len(h)), np.where(many, n, 1))
                within = np.arange(len(wide)) - np.searchsorted(wide, wide)
                h, first, n, parts = h[wide], first[wide] + np.where(many[wide], within, 0), np.where(many[wide], 1, n[wide]), parts[wide]
            w = word_hashes(raw.split()).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES].tobytes()
            found = [w[a:b] for a, b in zip((_WORD_BYTES * first).tolist(), (_WORD_BYTES * (first + n + WINDOW - 1)).tolist(), strict=True)]
            shard = h % shards
            if many.any():
                own = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) % parts.astype(np.uint64)
                shard = (shard + own.astype(np.int64)) % shards
            yield i, h.tolist(), first.tolist(), found, shard.tolist()

    def once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct contents of a task with their smallest document."""
        least: dict[tuple[int, int, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            shard, h, content = zip(*least, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(h, pa.int64()), pa.array(content, pa.binary()), pa.array(list(least.values()), pa.int64())], names=["shard", "h", "content", "doc"])
            least.clear()
            return out

        for batch in it:
            for piece in chunks(batch):
                docs = piece.column("doc_id").to_pylist()
                for i, h, _, found, shard in contents(piece):
                    doc = docs[i]
                    for key in zip(shard, h, found, strict=True):
                        if least.setdefault(key, doc) > doc:
                            least[key] = doc
                if len(least) > 100_000:
                    yield flush()
        if least:
            yield flush()

    def places(batch: pa.RecordBatch) -> dict:
        rows, h, first, c = [np.zeros(0, np.int64)], [], [], [np.zeros(0, np.int64)]
        for i, of_h, of_first, found, _ in contents(batch):
            rows.append(np.full(len(found), i))
            h += of_h
            first += of_first
            c.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64))
        at = pa.array(np.concatenate(rows))
        return {k: batch.column(n).take(at) for k, n in (("id", "doc_id"), ("t", "t"), ("t2", "t2"))} | {"h": h, "first": first, "c": pa.array(np.concatenate(c))}

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby(["h", "content"], as_index=False, sort=False)["doc"].min()
        sizes = pdf["content"].map(len).to_numpy() // _WORD_BYTES
        words = np.zeros((int(sizes.sum()), 8), np.uint8)
        words[:, :_WORD_BYTES] = np.frombuffer(b"".join(pdf["content"]), np.uint8).reshape(-1, _WORD_BYTES)
        found = first_documents(np.split(words.view("<u8").reshape(-1), np.cumsum(sizes)[:-1]), pdf["doc"].to_numpy(np.int64))
        return pd.DataFrame({"s_h": pdf["h"], "s_c": np.fromiter(map(xxhash.xxh3_64_intdigest, pdf["content"]), np.uint64, len(pdf)).view(np.int64), "docs": found})

    answers = mine.mapInArrow(settled(once), "shard int, h long, content binary, doc long").groupBy("shard").applyInPandas(search, "s_h long, s_c long, docs array<long>")
    at = arrow_map(mine, places, "id long, t long, t2 long, h long, first int, c long")
    hits = at.join(answers, (F.col("h") == F.col("s_h")) & (F.col("c") == F.col("s_c")))
    starts = F.filter(F.transform("docs", lambda x, i: F.when(x < F.col("id"), F.col("first") + i)), lambda x: x.isNotNull())
    own = [F.col(c).alias(f"r_{c}") for c in ("id", "t", "t2")]
    hits = hits.select(*own, starts.alias("starts")).where(F.size("starts") > 0).groupBy("r_id", "r_t", "r_t2").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    partial = hits.select("r_id", "r_t", "r_t2", F.lit(False).alias("whole"), "starts")
    copies = keys.join(firsts, ["t", "t2"]).where("id > m").select(*own, F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts")).distinct()
    return keyed, partial.unionByName(copies)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the kept words joined by one space) of every row of docs.

    Nulls: a null text has no words; a row without doc_id is neither earlier nor later than others and keeps its words. Rows with
    one doc_id do not count as earlier than each other. An empty table gives an empty result; other columns are not read.
    """
    keyed, gone = removals(docs.select("doc_id", "text"))

    def f(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_words", "n_removed", "kept_sha256", *["kept"] * with_text)}
        whole, starts = batch.column("whole").to_pylist(), batch.column("starts")
        for i, raw in enumerate(texts(batch)):
            words = raw.split()
            n = len(words)
            if whole[i] and n >= WINDOW:
                kept: list[bytes] = []
            elif whole[i] is False:
                edge = np.zeros(n + 1, np.int64)
                at = np.array(starts[i].as_py(), np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
            else:
                kept = words
            text = b" ".join(kept)
            for k, x in zip(out, (n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode()), strict=False):
                out[k].append(x)
        return {"doc_id": batch.column("doc_id")} | out

    here = (F.col("doc_id") == F.col("r_id")) & (F.col("t") == F.col("r_t")) & (F.col("t2") == F.col("r_t2"))
    rows = keyed.join(gone, here, "left").select("doc_id", "text", "whole", "starts")
    return arrow_map(rows, f, f"doc_id {type_of(docs, 'doc_id')}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(documents(spark, sf_dir))
