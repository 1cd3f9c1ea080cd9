"""SentencePiece encoding by sampling without replacement, and decoding.

A text's lattice has an edge for every piece that fits; a segmentation is a path. Pieces weigh by the merge order of the vocabulary, as a
Zipf law of rank: p(piece) ~ 1 / (rank + 2) ** THETA. Gumbel top-k: give every path its log-probability plus Gumbel noise and
keep the k largest. They are found without listing paths, by A-star search over sets of paths: the largest perturbed value
in a set has a Gumbel law located at the log of the set's mass, which the lattice gives exactly, so the queue's bounds are
the true maxima. Taking the best set means drawing its best path and splitting the rest of the set by where a path first leaves
it, each part with a maximum drawn below the one just taken.

No piece reaches over the start of a white-space run or a line feed (checked on loading), so a text's lattice is a chain of small ones, and
sets are told apart by the word in which a path first differs, and by the ways through that word already taken. A worker keeps
the lattices of words it has met. All noise is a hash of the row key, sample, place and step, so reruns agree.
Characters without a piece become their UTF-8 bytes' pieces, so decoding gives every text back exactly.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from formline.llm.common import CHUNK, arrow_map, documents, type_of

SAMPLES = 2
THETA = 1.0
#: Lattice nodes that a worker keeps; beyond them it starts anew. Results do not depend on it.
NODES = 400_000
#: Characters of texts that are sampled together.
TOGETHER = 1 << 18
#: A set of ways through a word that holds less than this share of its mass cannot be told from rounding and counts as empty.
LEAST_MASS = 1e-12
#: Steps of a way for which numbers are drawn for all texts at once.
_STEPS = 6
_CUT = re.compile(r" *[^ \n]+| +|\n")

_state: dict = {}


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte = {int(names[i][1:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no pieces for bytes")
        if any("\n" in names[i] or re.search("[^▁]▁", names[i]) for i in plain):
            raise ValueError("pieces reach over words")
        first = min(plain)
        # bytes stand behind all pieces; a white-space run has no merge rank in the file but its place
        weight = {i: -theta * math.log(i - first + 2) for i in plain}
        total = math.log(sum(map(math.exp, weight.values())))
        self.of = {names[i].replace("▁", " "): (i, weight[i] - total) for i in plain}
        self.byte_weight = -theta * math.log(self.size + 2) - total
        self.longest = max(map(len, self.of))
        #: What each id stands for; ids from `size` on are characters spelled in bytes, known to this object alone.
        self.text: list[bytes] = [b""] * self.size
        for s, (i, _) in self.of.items():
            self.text[i] = s.encode()
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        # the trie: transitions (state, character) in a hash table, and the piece that each state ends or -1
        states: dict[str, int] = {"": 0}
        for piece in self.of:
            for j in range(1, len(piece) + 1):
                states.setdefault(piece[:j], len(states))
        steps = [(states[x[:-1]] << 21 | ord(x[-1]), i) for x, i in states.items() if x]
        self._table(np.array([k for k, _ in steps]), np.array([i for _, i in steps]))
        self.trie_piece = np.full(len(states), -1)
        self.weight = np.zeros(self.size)
        for piece, (i, w) in self.of.items():
            self.trie_piece[states[piece]], self.weight[i] = i, w
        self.flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # the characters of self.text, their sizes and where each begins
        self.spelled: dict[str, int] = {}
        self.spelling: list[list[int]] = []

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _table(self, key: np.ndarray, to: np.ndarray) -> None:
        """Transitions by an open hash table of eight to sixteen slots a key; a key lies at most `probes` slots behind its own."""
        bits = (8 * len(key)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.trie_key, self.trie_to = np.full((1 << bits) + len(key), -1), np.full((1 << bits) + len(key), -1, np.int32)
        self.probes, at = 0, self._slot(key)
        while len(key):
            free = self.trie_key[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.trie_key[at[first]], self.trie_to[at[first]] = key[first], to[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, to, at = key[left], to[left], at[left] + 1
            self.probes += 1

    def next(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where each state's step by a character leads, or -1."""
        key = state.astype(np.int64) << 21 | char
        at = self._slot(key)
        there = self.trie_key[at]
        out = np.where(there == key, self.trie_to[at], np.int32(-1))
        more = np.flatnonzero((there != key) & (there >= 0))
        for probe in range(1, self.probes):
            if not len(more):
                break
            there = self.trie_key[at[more] + probe]
            hit = there == key[more]
            out[more[hit]] = self.trie_to[at[more[hit]] + probe]
            more = more[~hit & (there >= 0)]
        return out

    def spell(self, char: str) -> tuple[int, float]:
        """The id of a character without a piece, and its weight: a byte's own piece, or one that stands for several."""
        raw = char.encode()
        if len(raw) == 1:
            return self.byte[raw[0]], self.byte_weight
        if char not in self.spelled:
            self.spelled[char] = self.size + len(self.spelling)
            self.spelling.append([self.byte[b] for b in raw])
            self.text.append(raw)
        return self.spelled[char], len(raw) * self.byte_weight

    def public(self, ids: np.ndarray) -> np.ndarray:
        """ids with own ids replaced by those of bytes."""
        if not len(ids) or ids.max() < self.size:
            return ids
        return np.array([x for i in ids.tolist() for x in ([i] if i < self.size else self.spelling[i - self.size])], np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 texts of lists of ids, without the space that encoding has put before each."""
        if self.flat is None or len(self.flat[1]) < len(self.text):
            sizes = np.fromiter(map(len, self.text), np.int64, len(self.text))
            self.flat = np.frombuffer(b"".join(self.text), np.uint8), sizes, np.cumsum(sizes) - sizes
        chars, sizes, begins = self.flat
        every = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        size = sizes[every]
        upto = np.cumsum(size)
        raw = chars[np.repeat(begins[every] - upto + size, size) + np.arange(int(size.sum()))].tobytes()
        ends = np.append(0, upto)[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Lattices:
    """Word lattices in flat arrays with room to grow: nodes are numbered through; of an edge there are the cumulated probability, the length and number of its piece and the log of its probability."""

    _NODE = {"low": np.int32, "is_end": np.bool_}  # a node's first edge
    _EDGE = {"cum": np.float64, "length": np.uint8, "piece": np.int32, "logp": np.float64}

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.start: list[int] = []  # a word's first node
        for name, kind in (self._NODE | self._EDGE).items():
            setattr(self, name, np.zeros(0, kind))

    def _append(self, used: int, parts: dict[str, np.ndarray]) -> None:
        for name, more in parts.items():
            old = getattr(self, name)
            if used + len(more) > len(old):
                wider = np.zeros(max(3 * len(old) // 2, used + len(more)), old.dtype)
                wider[:used] = old[:used]
                setattr(self, name, old := wider)
            old[used : used + len(more)] = more

    def add(self, words: list[str]) -> None:
        """Lattices of new words, all at once: edges by a walk of the vocabulary's trie from every place, masses level by level from the words' ends."""
        if not words:
            return
        v = self.v
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        n = len(chars)
        word = np.repeat(np.arange(len(words)), sizes)
        end = np.cumsum(sizes)[word]
        found: list[tuple] = []  # of each step: first characters, pieces, weights, how many shorter pieces start there, and the length
        count = np.zeros(n, np.int64)
        at, state = np.arange(n), np.zeros(n, np.int64)
        for step in range(v.longest):
            fits = at + step < end[at]
            at, state = at[fits], state[fits]
            state = v.next(state, chars[at + step])
            there = state >= 0
            at, state = at[there], state[there]
            piece = v.trie_piece[state]
            whole = piece >= 0
            src, piece = at[whole], piece[whole]
            found.append((src, piece, v.weight[piece], count[src], step + 1))
            count[src] += 1
            if not step and len(alone := np.flatnonzero(count == 0)):  # characters without a piece
                which, back = np.unique(chars[alone], return_inverse=True)
                spelled = [v.spell(chr(c)) for c in which]
                found.append((alone, np.array([x[0] for x in spelled])[back], np.array([x[1] for x in spelled])[back], count[alone], 1))
                count[alone] += 1
            if not len(at):
                break
        # edges stand by their distance from the word's end, then by node, a node's longest piece first: mostly the likeliest
        far = end - np.arange(n)
        order = np.argsort(far.astype(np.int16) if n and far.max() < 1 << 15 else far, kind="stable")
        sizes_of = count[order]
        begins = np.cumsum(sizes_of) - sizes_of
        place = np.empty(n, np.int64)
        place[order] = begins + sizes_of
        total = int(sizes_of.sum())
        ids, length, weights = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total)
        for src, piece, weight, shorter, size in found:
            to = place[src] - 1 - shorter
            ids[to], weights[to], length[to] = piece, weight, size
        node = order + word[order]
        to_node = np.repeat(node, sizes_of) + length
        mass = np.zeros(n + len(words))  # log of the mass from a node to the word's end
        cuts = np.flatnonzero(np.diff(far[order])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            a, b = begins[lo], begins[hi - 1] + sizes_of[hi - 1]
            x, first = weights[a:b] + mass[to_node[a:b]], begins[lo:hi] - a
            top = np.maximum.reduceat(x, first)
            mass[node[lo:hi]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes_of[lo:hi])), first))
        logp = np.minimum(weights + mass[to_node] - np.repeat(mass[node], sizes_of), 0.0)
        share = np.exp(logp)
        total_share = np.cumsum(share)
        share = total_share - np.repeat(total_share[begins] - share[begins], sizes_of)
        share = np.clip(share, 0.0, np.nextafter(1.0, 0.0))  # only a node's last edge reaches 1
        share[begins + sizes_of - 1] = 1.0
        ends = np.zeros(n + len(words), bool)
        ends[np.cumsum(sizes + 1) - 1] = True
        low = np.full(n + len(words), -1)
        low[node] = self.edges + begins
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.start += (self.nodes + np.cumsum(sizes + 1) - (sizes + 1)).tolist()
        self._append(self.nodes, {"low": low, "is_end": ends})
        self._append(self.edges, {"cum": share, "length": length, "piece": ids, "logp": logp})
        self.nodes += n + len(words)
        self.edges += len(ids)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _uniform(seed: np.ndarray, sample: int, stream: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a row's seed, the sample, a stream (a step, or -1 for perturbation) and a place."""
    with np.errstate(over="ignore"):
        x = _mix(seed + np.uint64((sample * 0x9E3779B97F4A7C15 + (stream + 2) * 0xD1B54A32D192ED03) & (1 << 64) - 1))
        x = _mix(x + place.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def _below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at location that is known not to exceed bound; -inf at location -inf."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(-np.log(u) + np.exp(np.minimum(location - bound, 700.0))))


class _Sample:
    """One path for each text of a batch: its edges by word, and the maxima of the sets that splitting it leaves."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.logp = np.zeros(n)
        self.edge = self.at = self.region = None
        self.special: dict[int, tuple[int, list[tuple]]] = {}  # text: word, ways through it that are taken


def _draw(lat: Lattices, first: np.ndarray, idx: np.ndarray, seed: np.ndarray, sample: int, place: np.ndarray, out: _Sample) -> list:
    """Ways through the words idx; fills count and logp, returns (words, edges) of each step."""
    node, steps, step = first[idx].copy(), [], 0
    live = idx
    while len(live):
        x, e = _uniform(seed[live], sample, step, place[live]), lat.low[node]
        late = np.flatnonzero(lat.cum[e] <= x)
        while len(late):
            e[late] += 1
            late = late[lat.cum[e[late]] <= x[late]]
        steps.append((live, e))
        out.count[live] += 1
        out.logp[live] += lat.logp[e]
        node = node + lat.length[e]
        go = ~lat.is_end[node]
        live, node, step = live[go], node[go], step + 1
    return steps


def _otherwise(lat: Lattices, node: int, taken: list[tuple], uniform) -> tuple | None:
    """A way from node to its word's end that is none of taken, by their conditional probabilities."""
    way: list[int] = []
    left = list(taken)
    while not lat.is_end[node]:
        lo = int(lat.low[node])
        hi = lo + int(np.argmax(lat.cum[lo : lo + lat.v.longest] >= 1)) + 1
        p = np.exp(lat.logp[lo:hi]).tolist()
        for x in left:
            rest = math.exp(float(lat.logp[list(x[len(way) :])].sum()))
            p[x[len(way)] - lo] -= rest
        p = [max(0.0, x) for x in p]
        total = sum(p)
        if total <= 0:
            return None
        u, e = uniform(len(way)) * total, lo
        for k, x in enumerate(p):
            if x > 0:
                e = lo + k
            u -= x
            if u < 0:
                break
        way.append(e)
        left = [x for x in left if x[len(way) - 1] == e]
        node += int(lat.length[e])
    return tuple(way)


def _copy(dest: np.ndarray, dest_at: np.ndarray, src: np.ndarray, src_at: np.ndarray, count: np.ndarray, idx: np.ndarray) -> None:
    n = count[idx]
    if not n.sum():
        return
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    dest[np.repeat(dest_at[idx], n) + within] = src[np.repeat(src_at[idx], n) + within]


def sample_texts(lat: Lattices, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations, best perturbed value first: ids, log-probability, perturbed value, log of
    the probability of being included, given the largest value left out (0 where nothing is left out)."""
    words = [_CUT.findall(f" {x}") if x else [] for x in texts]
    if lat.nodes > NODES:
        lat.clear()
    sizes = np.array([len(x) for x in words], np.int64)
    n, ends = int(sizes.sum()), np.cumsum(sizes)
    begins = ends - sizes
    coded = pa.array(itertools.chain.from_iterable(words), pa.string(), size=n).dictionary_encode()  # so Python looks up each word once
    distinct = coded.dictionary.to_pylist()
    lat.add(list(itertools.filterfalse(lat.number.__contains__, distinct)))
    start = np.fromiter(map(lat.start.__getitem__, map(lat.number.__getitem__, distinct)), np.int64, len(distinct))
    first = start[coded.indices.to_numpy()] if n else start
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - begins[doc]
    seed = _mix(keys.astype(np.uint64))
    seed_of = seed[doc]
    full = np.flatnonzero(sizes)

    def per_text(x: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        if len(full):
            out[full] = np.maximum.reduceat(x, begins[full])
        return out

    none = np.zeros(len(texts), np.int64)
    value = -np.log(-np.log(_uniform(seed, 0, -1, none + (1 << 40))))
    samples: list[_Sample] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # texts that have a sample here, values, log-probabilities
    alive = np.ones(len(texts), bool)
    leave, parent = np.full(len(texts), -1, np.int64), none.copy()
    for s in range(k):
        new = _Sample(n)
        on = alive[doc]
        if s == 0:
            idx = np.arange(n)
        else:
            idx = np.flatnonzero(on & (place > leave[doc]))
        steps = _draw(lat, first, idx, seed_of, s, place, new)
        ways: dict[int, tuple] = {}
        if s:
            there = np.flatnonzero(alive)
            first_steps = [_uniform(seed[there], s, step, leave[there]).tolist() for step in range(_STEPS)]
            for j, t in enumerate(there.tolist()):
                at = int(begins[t] + leave[t])
                old = samples[parent[t]]
                word, taken = old.special.get(t, (-1, []))
                if word != leave[t]:
                    taken = [tuple(old.edge[old.at[at] : old.at[at] + old.count[at]].tolist())]
                way = _otherwise(lat, int(first[at]), taken, lambda step, t=t, s=s, j=j: first_steps[step][j] if step < _STEPS else float(_uniform(seed[t : t + 1], s, step, leave[t : t + 1])[0]))
                if way is None:
                    raise ArithmeticError("a set of paths that has mass has no path")
                ways[at] = way
                new.special[t] = (int(leave[t]), [*taken, way])
                new.count[at], new.logp[at] = len(way), float(lat.logp[list(way)].sum())
            for q, old in enumerate(samples):
                kept = np.flatnonzero(on & (place < leave[doc]) & (parent[doc] == q))
                new.count[kept], new.logp[kept] = old.count[kept], old.logp[kept]
        new.at = np.cumsum(new.count) - new.count
        new.edge = np.zeros(int(new.count.sum()), np.int64)
        for step, (w, e) in enumerate(steps):
            new.edge[new.at[w] + step] = e
        for at, way in ways.items():
            new.edge[new.at[at] : new.at[at] + len(way)] = way
        if s:
            for q, old in enumerate(samples):
                _copy(new.edge, new.at, old.edge, old.at, new.count, np.flatnonzero(on & (place < leave[doc]) & (parent[doc] == q)))
        total = np.cumsum(new.logp)
        before = np.where(place > 0, total - new.logp - (total[begins[doc]] - new.logp[begins[doc]]), 0.0) if n else total
        rest = -np.expm1(new.logp)
        for t, (w, taken) in new.special.items():
            rest[begins[t] + w] = 1 - sum(math.exp(float(lat.logp[list(x)].sum())) for x in taken)
        with np.errstate(divide="ignore"):
            location = np.where((rest > LEAST_MASS) & on & (place >= leave[doc]), before + np.log(np.maximum(rest, LEAST_MASS)), -np.inf)
        new.region = _below(location, value[doc], _uniform(seed_of, s, -1, place))
        samples.append(new)
        sums = np.zeros(len(texts))
        if len(full):
            sums[full] = np.add.reduceat(new.logp, begins[full])
        found.append((alive.copy(), value.copy(), sums))
        tops = np.stack([per_text(x.region) for x in samples]) if n else np.full((1, len(texts)), -np.inf)
        parent, value = tops.argmax(axis=0), tops.max(axis=0)
        alive = alive & (value > -np.inf)
        if s + 1 < k and alive.any():
            leave = np.full(len(texts), -1, np.int64)
            for q, x in enumerate(samples):
                hit = np.flatnonzero((x.region == value[doc]) & alive[doc] & (parent[doc] == q))
                leave[doc[hit[::-1]]] = place[hit[::-1]]
                chosen = np.flatnonzero(alive & (parent == q))
                x.region[begins[chosen] + leave[chosen]] = -np.inf
        elif not alive.any():
            break
    out: list[list] = [[] for _ in texts]
    left = np.where(value > -np.inf, value, -np.inf)
    for x, (there, values, sums) in zip(samples, found, strict=True):
        ids = lat.piece[x.edge] if len(x.edge) else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(x.count)])
        for t in np.flatnonzero(there).tolist():
            d = sums[t] - left[t]
            inclusion = 0.0 if d > 700 else d if d < -30 else math.log(-math.expm1(-math.exp(d)))
            out[t].append((ids[upto[begins[t]] : upto[ends[t]]], float(sums[t]), float(values[t]), float(inclusion)))
    return out


def _lattices(path: str) -> Lattices:
    if path not in _state:
        _state[path] = Lattices(Vocabulary(path))
    return _state[path]


def _keys(ids: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(repr(x)) for x in ids], np.uint64)


def _batches(batch: pa.RecordBatch, path: str, k: int):
    """(row, text, samples) of a batch, of which parts of about TOGETHER characters are sampled together."""
    lat = _lattices(path)
    ids, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        yield from zip(range(at, end), texts[at:end], sample_texts(lat, texts[at:end], _keys(ids[at:end]), k), strict=True)
        at = end


def encode(docs: DataFrame, k: int = SAMPLES, path: str | None = None) -> DataFrame:
    """Up to k rows for each row of docs: doc_id, sample (from 0), ids, log_p, perturbed, log_inclusion.

    A text with fewer than k segmentations gives all of them. A null or empty text has one, without ids. Repeated rows give equal rows:
    the noise follows doc_id. An empty table gives an empty result; other columns are not read.
    """
    path = path or model_file()

    def f(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("row", "sample", "ids", "log_p", "perturbed", "log_inclusion")}
        vocabulary = _lattices(path).v
        for row, _, samples in _batches(batch, path, k):
            for s, (ids, *scores) in enumerate(samples):
                for c, x in zip(out, (row, s, vocabulary.public(ids), *scores), strict=True):
                    out[c].append(x)
        return {"doc_id": batch.column("doc_id").take(pa.array(out.pop("row"), pa.int64()))} | out

    return arrow_map(docs.select("doc_id", "text"), f, f"doc_id {type_of(docs, 'doc_id')}, sample int, ids array<int>, log_p double, perturbed double, log_inclusion double", CHUNK // 4, lambda: _lattices(path).clear())


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows(doc_id, sample, ids) to doc_id, sample, text. Null ids give a null text, no ids an empty one."""
    path = path or model_file()

    def f(batch: pa.RecordBatch) -> dict:
        vocabulary = _lattices(path).v
        ids = batch.column("ids").to_pylist()
        found = vocabulary.decode([np.array(x or [], np.int64) for x in ids])
        text = [None if x is None else y.decode() for x, y in zip(ids, found, strict=True)]
        return {"doc_id": batch.column("doc_id"), "sample": batch.column("sample"), "text": text}

    return arrow_map(rows.select("doc_id", "sample", "ids"), f, f"doc_id {type_of(rows, 'doc_id')}, sample int, text string")


def op2_pieces(spark: SparkSession, sf_dir: str, k: int = SAMPLES) -> DataFrame:
    """All documents, one row each: doc_id, n_tokens, ids_crc32, log_p and log_inclusion of each sample, and whether all of them decode to the text."""
    docs, path = documents(spark, sf_dir).select("doc_id", "text"), model_file()

    def f(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("n_tokens", "ids_crc32", "log_p", "log_inclusion", "decoded")}
        vocabulary = _lattices(path).v
        for _, text, samples in _batches(batch, path, k):
            ids = [vocabulary.public(x[0]).astype("<u4") for x in samples]
            out["n_tokens"].append([len(x) for x in ids])
            out["ids_crc32"].append([zlib.crc32(x.tobytes()) for x in ids])
            out["log_p"].append([x[1] for x in samples])
            out["log_inclusion"].append([x[3] for x in samples])
            raw = text.encode()
            out["decoded"].append(all(x == raw for x in vocabulary.decode(ids)))
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(docs, f, f"doc_id {type_of(docs, 'doc_id')}, n_tokens array<long>, ids_crc32 array<long>, log_p array<double>, log_inclusion array<double>, decoded boolean", CHUNK // 4, lambda: _lattices(path).clear())
