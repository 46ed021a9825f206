"""Operator 10, SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A text's segmentations are the paths of a lattice whose edges are the vocabulary's pieces (bytes for characters that no piece covers); a path's
weight is the product of its pieces' weights, (rank + 2) ** -alpha. Backward sums over the lattice give each node's total, so every
edge has its exact probability given its node. A* search with perturbed bounds then draws the k paths of largest Gumbel-perturbed log-probability,
which is sampling k distinct segmentations without replacement: the whole space has a Gumbel bound; its best path is a sample; what it leaves splits into
regions (same path up to a token, another edge there), each with its own Gumbel under the parent's; the region with the largest bound is next. A sample's inclusion
score is the chance that its perturbed value passes the bound of the best region left, 1 - exp(-exp(log p - bound)); p over it is the usual importance weight.

No piece holds a word mark after another character, so the lattice of a text is the chain of its words' lattices, each computed once per
batch for all its uses; all sums run on arrays over many words at once. Random numbers are a hash of seed, row key and place in the text:
neither batches nor partitions nor retries change a result. Texts are encoded whole, where they lie, without a shuffle.

The vocabulary's path is a parameter, read on the driver; its pieces and ranks (a bounded size) go to the workers by value.

Cases: a null text is empty; an empty text has one segmentation, without tokens; fewer than k segmentations give all of them, with
inclusion 1; a null key counts as the hash of null; rows that repeat key and text repeat their samples; word marks in the text itself are encoded as bytes, so decoding gives
back every text exactly; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 3
ALPHA = 1.0
SEED = 42
MARK = "▁"
#: Stands for a mark in the text itself; a lone surrogate, which no UTF-8 text holds.
_LITERAL = "\udfff"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of one round of array work.
_ROUND = 400_000
#: Pieces that are decoded at a time.
_PIECES = 1 << 16


def load_vocabulary(path: str = MODEL) -> tuple[tuple[str, ...], tuple[float, ...], int]:
    """Pieces and ranks by id, and the id of byte zero. Control pieces are empty strings."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces = tuple("" if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) else p.id_to_piece(i) for i in range(n))
    ranks = tuple(min(-p.get_score(i), float(n)) if pieces[i] else float(n) for i in range(n))
    return pieces, ranks, next(i for i in range(n) if p.is_byte(i))


class Vocabulary:
    """Tables over characters and trie states, for array lookups."""

    def __init__(self, pieces: tuple[str, ...], ranks: tuple[float, ...], byte0: int, alpha: float) -> None:
        self.size, self.byte0 = len(pieces), byte0
        self.weight = (np.array(ranks) + 2.0) ** -alpha
        self.bytes = [p.replace(MARK, " ").encode() for p in pieces]
        for b in range(256):
            self.bytes[byte0 + b] = bytes([b])
        # The same side by side, for decoding on arrays.
        self.flat, self.sizes = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(x) for x in self.bytes])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        nodes: dict[str, int] = {}
        inner = {p[:n] for p in pieces for n in range(1, len(p))}
        for prefix in sorted(inner):
            nodes[prefix] = len(nodes) + 1
        self.inner = len(nodes) + 1
        for p in pieces:
            if p and p not in nodes:
                nodes[p] = len(nodes) + 1
        chars = sorted({c for p in pieces for c in p})
        if len(chars) > 4095:  # a step's key has twelve bits for its character
            raise ValueError(f"the vocabulary has {len(chars)} distinct characters, more than 4095")
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        # Steps from a state: a hash table with linear probing, sparse enough for short runs.
        steps = {(nodes[x[:-1]] if len(x) > 1 else 0) * 4096 + number[x[-1]]: s for x, s in nodes.items()}
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.probes = 1
        for key, s in steps.items():
            at, n = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[at], self.to[at] = key, s
            self.probes = max(self.probes, n)
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        for i, p in enumerate(pieces):
            if p:
                self.piece[nodes[p]] = i
        self.longest = max(map(len, pieces), default=1)
        self.start = np.zeros(len(chars) + 1, np.int32)
        for x, state in nodes.items():
            if len(x) == 1:
                self.start[number[x]] = state

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next trie states, 0 where there is none."""
        key = state.astype(np.int64) * 4096 + char
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(pieces: tuple[str, ...], ranks: tuple[float, ...], byte0: int, alpha: float) -> Vocabulary:
    return Vocabulary(pieces, ranks, byte0, alpha)


class Lattices:
    """The lattices of distinct words. Node (word, r): r characters before the word's end; nodes of one r lie side by side, longest words first."""

    def __init__(self, v: Vocabulary, words: list[str]) -> None:
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.length = length
        top = int(length.max())
        count = np.zeros(top + 2, np.int64)
        count[0] = len(words)
        sizes = np.bincount(length, minlength=top + 2)
        for r in range(1, top + 1):
            count[r] = count[r - 1] - sizes[r - 1]
        self.base = np.concatenate([[0], np.cumsum(count)])
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(length)[order]
        chars, codes = [None], [None]
        for r in range(1, top + 1):
            code = flat[ends[: count[r]] - r]
            codes.append(code)
            chars.append(v.char[code])
        # Characters that no piece covers become runs of bytes: one-byte ones a byte's id, others ids beyond the vocabulary.
        self.unknown: list[bytes] = []
        known: dict[int, int] = {}
        byte_weight = float(v.weight[v.byte0])
        # Total weight of the paths from each node to its word's end, up to a factor of the word: probabilities are ratios.
        beta = [np.ones(count[0])]
        first, piece, to, cum, prob = [np.zeros(count[0], np.int64)], [], [], [], []
        n_edges = 0
        for r in range(1, top + 1):
            n = int(count[r])
            who, state, found = np.arange(n), v.start[chars[r]], []
            single = v.piece[state]
            single[state == 0] = -1
            missing = np.flatnonzero(single < 0)
            for j in range(1, min(r, v.longest) + 1):
                ids = v.piece[state]
                hit = np.flatnonzero((state > 0) & (ids >= 0))
                if len(hit):
                    t = who[hit]
                    found.append((j, t, ids[hit], v.weight[ids[hit]] * beta[r - j][t]))
                alive = np.flatnonzero((state > 0) & (state < v.inner))
                if j == r or not len(alive):
                    break
                who = who[alive]
                state = v.step(state[alive], chars[r - j][who])
            if len(missing):
                ids = np.empty(len(missing), np.int64)
                for i, code in enumerate(codes[r][missing].tolist()):
                    if code not in known:
                        raw = (MARK if chr(code) == _LITERAL else chr(code)).encode("utf-8", "surrogatepass")
                        known[code] = v.byte0 + raw[0] if len(raw) == 1 else v.size + len(self.unknown)
                        if len(raw) > 1:
                            self.unknown.append(raw)
                    ids[i] = known[code]
                many = np.array([1 if i < v.size else len(self.unknown[i - v.size]) for i in ids.tolist()])
                found.append((1, missing, ids, byte_weight**many * beta[r - 1][missing]))
            total, degree = np.zeros(n), np.zeros(n, np.int64)
            for _, t, _, w in found:
                total[t] += w
                degree[t] += 1
            beta.append(total.copy())
            if len(far := np.flatnonzero((total < 1e-100) | (total > 1e100))):  # the nodes that later ones still reach are scaled alike
                scale = 1.0 / total[far]
                for q in range(max(0, r - v.longest), r + 1):
                    beta[q][far] *= scale
            start = n_edges + np.concatenate([[0], np.cumsum(degree)])
            m = int(start[-1] - n_edges)
            e_piece, e_to, e_cum, e_prob = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m), np.empty(m)
            slot, run = start[:-1] - n_edges, np.zeros(n)
            for j, t, ids, w in found:
                at, p = slot[t], w / total[t]
                run[t] += p
                e_piece[at], e_to[at], e_cum[at], e_prob[at] = ids, self.base[r - j] + t, run[t], p
                slot[t] += 1
            e_cum[start[1:] - n_edges - 1] = 2.0  # the last edge takes what rounding leaves
            first.append(start[:-1])
            for whole, part in ((piece, e_piece), (to, e_to), (cum, e_cum), (prob, e_prob)):
                whole.append(part)
            n_edges += m
        self.first = np.concatenate([*first, [n_edges]])
        self.first[: count[0]] = 0
        self.piece, self.to, self.cum, p = (np.concatenate(x) for x in (piece, to, cum, prob))
        with np.errstate(divide="ignore"):
            self.logp = np.log(p)
            self.rest = np.where(p < 1 - 1e-12, np.log1p(-np.minimum(p, 1.0)), -np.inf)  # what the node's other edges hold
        self.ends = int(count[0])  # nodes below this are words' ends

    def start(self, word: np.ndarray) -> np.ndarray:
        return self.base[self.length[word]] + self.rank[word]

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its probability."""
        edge = self.first[node]
        open_ = np.flatnonzero(u >= self.cum[edge])
        while len(open_):
            edge[open_] += 1
            open_ = open_[u[open_] >= self.cum[edge[open_]]]
        return edge


def _uniform(key: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """In (0, 1), of a hash (splitmix64) of key and two numbers."""
    with np.errstate(over="ignore"):
        z = key + np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _walk(lat: Lattices, node: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths from nodes to their words' ends: edges in order, and how many each has."""
    n = len(node)
    count, steps, who, at, s = np.zeros(n, np.int64), [], np.flatnonzero(node >= lat.ends), node, 0
    at = node[who]
    while len(who):
        edge = lat.pick(at, _uniform(key[who], place[who] * 64 + sample, s + 1))
        steps.append((who, edge))
        count[who] += 1
        at = lat.to[edge]
        on = at >= lat.ends
        who, at, s = who[on], at[on], s + 1
    offset = np.cumsum(count) - count
    edges = np.empty(int(count.sum()), np.int64)
    for s, (who, edge) in enumerate(steps):
        edges[offset[who] + s] = edge
    return edges, count


class _Sample:
    """The s-th sample of each text that has one: edges, the place of each edge's word, and for the region that each edge leaves
    the logarithm of an exponential arrival time of rate exp(mass): minus a Gumbel at ``mass``, before its parent's bound is put on."""

    __slots__ = ("docs", "edges", "place", "start", "logp", "value", "time", "branch", "excluded")


def sample_texts(v: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int = K) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text, up to k (ids, log-probability, inclusion) in order of their perturbed values; ``keys``: unsigned 64-bit row seeds."""
    units, n_units = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = _UNIT.findall((MARK + t.replace(MARK, _LITERAL).replace(" ", MARK)))
            units += found
            n_units[i] = len(found)
    out: list[list] = [[] if n else [(np.zeros(0, np.int32), 0.0, 1.0)] for n in n_units]
    if not units:
        return out
    index = {w: i for i, w in enumerate(dict.fromkeys(units))}
    word = np.fromiter(map(index.__getitem__, units), np.int64, len(units))
    del units
    lat = Lattices(v, list(index))
    del index
    live = np.flatnonzero(n_units)
    u_start = np.cumsum(n_units) - n_units
    doc_of = np.repeat(np.arange(len(texts)), n_units)
    place_of = np.arange(len(word)) - u_start[doc_of]
    begin = lat.start(word)
    samples: list[_Sample] = []

    def finish(s: _Sample, number: int) -> None:
        """Bounds of the regions that each path leaves, from its branch on."""
        lp = lat.logp[s.edges]
        sizes = np.diff(s.start)
        which = np.repeat(np.arange(len(s.docs)), sizes)
        before = np.cumsum(lp) - lp
        before -= before[s.start[:-1]][which]
        s.logp = np.add.reduceat(lp, s.start[:-1])
        mass = before + lat.rest[s.edges]
        at = np.arange(len(lp)) - s.start[:-1][which]
        for i, extra in enumerate(s.excluded):
            if extra:
                j = s.start[i] + s.branch[i]
                left = 1 - float(np.exp(lat.logp[[*extra, s.edges[j]]]).sum())
                mass[j] = before[j] + math.log(left) if left > 1e-12 else -np.inf
                mass[s.start[i] : j] = -np.inf  # those regions are the parent's
        s.time = np.log(-np.log(_uniform(keys[s.docs][which], at, 1_000_003 + number))) - mass

    first = _Sample()
    first.docs = live
    first.edges, count = _walk(lat, begin, keys[doc_of], place_of, 0)
    first.place = np.repeat(place_of, count)
    per_doc = np.add.reduceat(count, u_start[live])
    first.start = np.concatenate([[0], np.cumsum(per_doc)])
    first.value = -np.log(-np.log(_uniform(keys[live], 0, 999_983)))
    first.branch, first.excluded = np.zeros(len(live), np.int64), [()] * len(live)
    finish(first, 0)
    samples.append(first)
    bound = np.full(len(texts), -np.inf)
    for number in range(1, k + 1):
        # The best region of each text over all its samples.
        best, chosen = np.full(len(texts), -np.inf), {}
        for m, s in enumerate(samples):
            soonest = np.minimum.reduceat(s.time, s.start[:-1])
            top = np.where(np.isfinite(soonest), -np.logaddexp(-s.value, np.where(np.isfinite(soonest), soonest, 0.0)), -np.inf)  # a Gumbel below the parent's
            for i in np.flatnonzero(top > best[s.docs]).tolist():
                best[s.docs[i]] = top[i]
                chosen[int(s.docs[i])] = (m, i)
        bound = best
        if number == k or not chosen:
            break
        new = _Sample()
        docs = sorted(chosen)
        new.docs, new.excluded, new.branch, new.value = np.array(docs), [], np.zeros(len(docs), np.int64), best[docs]
        heads, nodes, places, owners, sizes = [], [], [], [], []
        for i, d in enumerate(docs):
            m, at = chosen[d]
            s = samples[m]
            a, b = int(s.start[at]), int(s.start[at + 1])
            j = int(np.argmin(s.time[a:b]))
            s.time[a + j] = np.inf
            edge = int(s.edges[a + j])
            # The node of an edge: the last whose edges begin at or before it.
            gone = (*(s.excluded[at] if j == s.branch[at] else ()), edge)
            lo, hi = _edges_of(lat, edge)
            p = np.exp(lat.logp[lo:hi])
            p[[e - lo for e in gone]] = 0.0
            c = np.cumsum(p)
            u = float(_uniform(keys[d : d + 1], number, 1_299_709)[0]) * c[-1]
            other = lo + min(int(np.searchsorted(c, u, side="right")), hi - lo - 1)
            while other in gone:
                other -= 1
            place = int(s.place[a + j])
            heads.append((s.edges[a : a + j], s.place[a : a + j], other, place))
            rest = slice(u_start[d] + place + 1, u_start[d] + n_units[d])
            nodes.append(np.concatenate([[lat.to[other]], begin[rest]]))
            places.append(np.arange(place, n_units[d]))
            owners.append(np.full(int(n_units[d]) - place, d))
            sizes.append(int(n_units[d]) - place)
            new.excluded.append(gone)
            new.branch[i] = j
        place, owner = np.concatenate(places), np.concatenate(owners)
        tail, count = _walk(lat, np.concatenate(nodes), keys[owner], place, number)
        tail_place = np.repeat(place, count)
        cut_at = np.cumsum(np.add.reduceat(count, np.cumsum(sizes) - sizes))[:-1]
        edges, spots, lengths = [], [], []
        for (head, head_place, other, p), t, tp in zip(heads, np.split(tail, cut_at), np.split(tail_place, cut_at), strict=True):
            edges += [head, [other], t]
            spots += [head_place, [p], tp]
            lengths.append(len(head) + 1 + len(t))
        new.edges, new.place = np.concatenate(edges).astype(np.int64), np.concatenate(spots).astype(np.int64)
        new.start = np.concatenate([[0], np.cumsum(lengths)])
        finish(new, number)
        samples.append(new)
    for s in samples:
        ids = lat.piece[s.edges]
        for i, d in enumerate(s.docs.tolist()):
            got = ids[s.start[i] : s.start[i + 1]]
            if len(lat.unknown) and (got >= v.size).any():
                got = np.concatenate([[x] if x < v.size else v.byte0 + np.frombuffer(lat.unknown[x - v.size], np.uint8).astype(np.int64) for x in got.tolist()])
            lp = float(s.logp[i])
            inclusion = 1.0 if bound[d] == -np.inf else -math.expm1(-math.exp(min(lp - bound[d], 700.0)))
            out[d].append((got.astype(np.int32), lp, inclusion))
    return out


def _edges_of(lat: Lattices, edge: int) -> tuple[int, int]:
    """The range of edges that leave the node of ``edge``."""
    i = int(np.searchsorted(lat.first[lat.ends :], edge, side="right")) - 1 + lat.ends
    return int(lat.first[i]), int(lat.first[i + 1])


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of a segmentation: bytes joined, the leading mark's space dropped."""
    parts = []
    for i in range(0, len(ids), _PIECES):
        sizes = v.sizes[part := ids[i : i + _PIECES]]
        ends = np.cumsum(sizes)
        parts.append(v.flat[np.repeat(v.offsets[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
    return b"".join(parts).decode("utf-8", "surrogatepass")[1:]


SAMPLES = "samples array<struct<n_tokens:int,log_prob:double,inclusion:double,ids_sha256:string,exact:boolean>>"
SAMPLES_IDS = "samples array<struct<n_tokens:int,log_prob:double,inclusion:double,ids_sha256:string,exact:boolean,ids:array<int>>>"


def encode_samples(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, k: int = K, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """``key`` and ``samples`` of each row: token counts, log-probabilities, inclusion scores, SHA-256 of the ids (32-bit, little-endian), whether decoding gives the text, and the ids if asked for."""
    pieces, ranks, byte0 = load_vocabulary(model)
    rows = docs.select(F.col(key_col).alias("key"), F.xxhash64(F.lit(seed), F.col(key_col)).alias("row_seed"), F.col(text_col).alias("text"))
    struct = [("n_tokens", pa.int32()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("ids_sha256", pa.string()), ("exact", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids
    shared = docs.sparkSession.sparkContext.broadcast((pieces, ranks))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*shared.value, byte0, alpha)
        for batch in batches:
            texts, seeds = batch.column(2).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= _ROUND):
                    size += len(texts[j] or "")
                    j += 1
                rows = []
                for text, found in zip(texts[i:j], sample_texts(v, texts[i:j], seeds[i:j], k), strict=True):
                    rows.append([
                        {"n_tokens": len(ids), "log_prob": lp, "inclusion": q, "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), "exact": decode(v, ids) == (text or "")}
                        | ({"ids": ids.tolist()} if with_ids else {})
                        for ids, lp, q in found
                    ])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(rows, pa.list_(pa.struct(struct)))], names=["key", "samples"])
                i = j

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {SAMPLES_IDS if with_ids else SAMPLES}")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: per sample, in order, its figures; ``exact``: every sample decodes to the text."""
    return found.select(
        F.col("key").alias("doc_id"), F.size("samples").alias("n_samples"), F.col("samples.n_tokens").alias("n_tokens"), F.col("samples.log_prob").alias("log_prob"),
        F.col("samples.inclusion").alias("inclusion"), F.col("samples.ids_sha256").alias("ids_sha256"), F.forall("samples", lambda s: s["exact"]).alias("exact"),
    )
