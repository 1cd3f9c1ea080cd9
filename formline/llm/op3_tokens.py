"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Every id is replaced by its rank by corpus frequency, so frequent ids take one byte. A control byte holds the
byte lengths (1 to 4) of four values, two bits each; data bytes follow in a column of their own. Decoding looks the control bytes
up in a table of 256 rows and gathers the data bytes with numpy. A file is a Parquet part of blocks: documents in ascending
doc_id order, of about BLOCK ids together, with the block's place within its shard; a codebook beside them maps ranks to ids.
Texts are tokenised and their ids counted once, where they lie; vocabulary numbers are then shuffled, by ranges of doc_id, in the texts' stead.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import CHUNK, arrow_map, chunks, documents, materialize, settled, type_of

BLOCK = 1 << 18
END_ID = 2
#: Words whose ids a worker remembers in each of two generations: when the young one is full it becomes the old one, and words met again
#: move back. Results do not depend on it.
REMEMBERED = 700_000
#: New words that the library encodes as one text.
TOGETHER = 64
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between words of such a text; it is one id, which no word without this character has.
_MARK = "\x01"
_ENDED = re.compile(rb"[A-Za-z0-9][!-/:-@\[-`{-~]").fullmatch

_state: dict = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The ids of a text, word by word. For tokenizers that split on white space before anything else, as word_bpe_49k does; a look at the file's own rules confirms it."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        #: How ids are held: two bytes each where they fit.
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()
        rules = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in rules["normalizer"]["normalizers"]]
        mark = self._encode([_MARK])[0]
        if kinds != ["NFC", "Replace", "Lowercase"] or rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _RULE or len(mark) != 1:
            raise ValueError(f"{path} does not split texts as this class does")
        self.mark = mark[0]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, some: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, fresh: set[bytes]) -> None:
        """Ids of words not met before: the library encodes them with marks between them, and the marks' ids tell where each ends.

        A letter or digit of ASCII and a last sign are parts apart, so such a word has the ids of what stands before and those of the sign.
        """
        mark, known = _MARK.encode(), self.young
        known[b""] = b""
        ended = [w for w in fresh if _ENDED(w[-2:])]
        fresh = fresh.difference(ended).union(x for w in ended for x in (w[:-1], w[-1:]) if x not in known)
        alone = [w for w in fresh if mark in w]
        for w, ids in zip(alone, self._encode([w.decode() for w in alone]), strict=True):
            known[w] = np.array(ids, self.kind).tobytes()
        words = [w for w in fresh if w and mark not in w]
        between = b" " + mark + b" "
        for at in range(0, len(words), 100 * TOGETHER):
            some = words[at : at + 100 * TOGETHER]
            found = self._encode([(between.join(some[k : k + TOGETHER]) + between).decode() for k in range(0, len(some), TOGETHER)])
            ids = np.concatenate([np.array(x, self.kind) for x in found])
            raw, begin = ids.tobytes(), 0
            for w, mark_at in zip(some, (ids.itemsize * np.flatnonzero(ids == self.mark)).tolist(), strict=True):
                known[w] = raw[begin:mark_at]
                begin = mark_at + ids.itemsize
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def bodies(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: none) and its end id, as little-endian numbers of self.kind.

        Arrow splits the texts and numbers their distinct words, so Python sees those alone.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = split.flatten().dictionary_encode()
        which, names = words.indices.to_numpy(), words.dictionary
        # the tokenizer lower-cases everything but special tokens; ASCII alone has no marks that would compose otherwise then
        plain = pc.and_(pc.string_is_ascii(names), pc.invert(pc.match_substring(names, "<|")))
        distinct = pc.if_else(plain, pc.ascii_lower(names), names).cast(pa.binary()).to_pylist()
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        if fresh := set(itertools.filterfalse(young.__contains__, distinct)):
            again = fresh & old.keys()
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            self._learn(fresh - again)
        # one more "word" ends each text; splitting leaves empty words, which have no ids
        found = [*map(young.__getitem__, distinct), self.end]
        size = np.fromiter(map(len, found), np.int32, len(found)) // len(self.end)
        begin = np.cumsum(size, dtype=np.int32) - size
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        which = np.insert(which, ends, len(distinct))
        size, begin = size[which], begin[which]
        upto = np.cumsum(size, dtype=np.int32)  # a slice of a batch has fewer than 2 ** 31 bytes
        ids = np.frombuffer(b"".join(found), self.kind)[np.repeat(begin - upto + size, size) + np.arange(int(size.sum()), dtype=np.int32)]
        offsets = np.append(0, upto[ends + np.arange(len(ends))]) * len(self.end)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])


def _tokenizer(path: str, end_id: int) -> WordTokenizer:
    if (path, end_id) not in _state:
        _state[path, end_id] = WordTokenizer(path, end_id)
    return _state[path, end_id]


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and body, the ids of each text by vocabulary number with the end id. A task's last row (last is true) has no document but, in counts, how often each id came in the task."""
    key = to_arrow_schema(docs.select("doc_id").schema).field("doc_id").type
    schema = pa.schema([("doc_id", key), ("body", pa.binary()), ("last", pa.bool_()), ("counts", pa.binary())])

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path, end_id)
        total = np.zeros(tok.size, np.int64)
        for batch in it:
            for piece in chunks(batch, 2 * CHUNK):
                bodies = tok.bodies(piece.column("text"))
                total += np.bincount(np.frombuffer(bodies.buffers()[2], tok.kind), minlength=len(total))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(key), bodies, pa.repeat(False, len(bodies)), pa.nulls(len(bodies), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"doc_id": None, "body": None, "last": True, "counts": total.astype("<i8").tobytes()}], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(settled(f), f"doc_id {type_of(docs, 'doc_id')}, body binary, last boolean, counts binary")


def frequencies(counts: DataFrame) -> DataFrame:
    """(id, n) from the counts of tokenise()'s tasks; at most one row for each id of the vocabulary and task before the shuffle."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for raw in batch.column("counts").to_pylist():
                total = np.frombuffer(raw, "<i8")
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    return counts.mapInArrow(f, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values. Places behind the last value have length 1 and no data."""
    v = np.ascontiguousarray(values, "<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = length - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that encode_values() has written."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for byte in range(1, 4):
        more = np.flatnonzero(length > byte)
        if not len(more):
            break
        out[more] |= raw[at[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(blocks, codebook) as stored: blocks(shard, block, at, doc_ids, counts, control, data), codebook(rank, id).

    Nulls: a null text is empty and has its end id alone; a null doc_id comes first. Rows with equal doc_id stand in order of their
    ids. An empty table gives no blocks and an empty codebook. Other columns are not read.
    """
    path = path or tokenizer_file()
    spark = docs.sparkSession
    stored = materialize(tokenise(docs, path, end_id), "op3-bodies", "zstd")
    bodies = stored.where("not last").select("doc_id", "body")
    counted = frequencies(stored.where("last").select("counts")).collect()  # a row for each id of the vocabulary at most
    ids = [i for i, _ in sorted(((r["id"], r["n"]) for r in counted), key=lambda x: (-x[1], x[0]))]
    codebook = materialize(spark.createDataFrame(list(enumerate(ids)), "rank int, id long"), "op3-codebook")
    rank = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    schema = f"shard int, block int, at long, doc_ids array<{type_of(docs, 'doc_id')}>, counts array<long>, control binary, data binary"

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shard, block, at = np.dtype(_tokenizer(path, end_id).kind), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            control, data = encode_values(rank[np.frombuffer(b"".join(held), kind)])
            row = {"shard": [shard], "block": [block], "at": [at], "doc_ids": [keys], "counts": [[len(b) // kind.itemsize for b in held]], "control": [control], "data": [data]}
            kinds = {"shard": pa.int32(), "block": pa.int32(), "at": pa.int64(), "doc_ids": pa.list_(key_type), "counts": pa.list_(pa.int64()), "control": pa.binary(), "data": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in row.items()], names=list(row))

        for batch in it:
            key_type = batch.column("doc_id").type
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                keys.append(key)
                held.append(body)
                size += len(body) // kind.itemsize
                if size >= BLOCK:
                    yield flush()
                    at, block, size = at + size, block + 1, 0
                    keys, held = [], []
        if keys:
            yield flush()

    ordered = bodies.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
    return materialize(ordered.mapInArrow(f, schema), "op3-tokens"), codebook


def read_tokens(blocks: DataFrame, codebook: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    ids = np.array([r["id"] for r in codebook.orderBy("rank").collect()], "<u4")  # of the vocabulary's size at most
    totals = blocks.groupBy("shard").agg((F.max("at")).alias("last"), F.max_by(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), "at").alias("n"))
    bases = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum(F.col("last") + F.col("n")).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.join(bases, blocks["shard"] == bases["_shard"]).select((F.col("base") + F.col("at")).alias("at"), "doc_ids", "counts", "control", "data")
    key = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def f(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)}
        for row in batch.to_pylist():
            n = np.array(row["counts"], np.int64)
            found = ids[decode_values(row["control"], row["data"], int(n.sum()))]
            ends = np.cumsum(n)
            out["doc_id"] += row["doc_ids"]
            out["start"] += (row["at"] + ends - n).tolist()
            out["n_tokens"] += row["counts"]
            raw = memoryview(found.tobytes())
            out["ids_crc32"] += [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(ends.tolist(), row["counts"], strict=True)]
            if with_ids:
                out["ids"] += [found[b - c : b].astype(np.int64) for b, c in zip(ends.tolist(), row["counts"], strict=True)]
        return out

    return arrow_map(placed, f, f"doc_id {key}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from the files read back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(*write_tokens(documents(spark, sf_dir)), with_ids=False)
