"""SentencePiece encoding and decoding with sampled segmentations.

Gumbel top-k without replacement: every segmentation of a text has a log probability under the pieces' weights, and a
Gumbel perturbation; the k largest perturbed ones are k distinct samples. A perturbed A* search finds them without listing
any others: a node is a set of segmentations that share their beginning, its bound the largest perturbed value among them,
drawn from the Gumbel distribution of its mass below its parent's bound. Inclusion scores follow from the first value left
out. All draws come from the row's key, so a row's samples depend on nothing else.

No piece crosses the beginning of a run of spaces or a line end, so a text's lattice is a chain of lattices of units, cut
there and nowhere else. A worker keeps those it has built, up to KEPT_UNITS and KEPT_POSITIONS, and builds and sums the new
ones of a batch at once in numpy.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlytics.llm import texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 17
#: Bounds this far below the last one needed are left out: they matter with probability e^-30.
NEGLIGIBLE = 30.0
#: Rank at which a piece's weight has fallen to half of the first one's.
HALF_RANK = 10.0

#: Units whose lattices a worker remembers, and their characters; a batch that brings more is still held whole.
KEPT_UNITS, KEPT_POSITIONS = 150_000, 2_000_000
#: Characters below this have a table of their own in the trie.
COMMON = 384

_STEP, _ROW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_WORD, _MIXES = (1 << 64) - 1, texts.MIXES
_TOP = (1 << 32) - 1


class Vocabulary:
    """Pieces in a trie of sorted (node, character) codes.

    The files are byte-pair models whose scores are merge ranks, so a piece's weight is taken as 1 / (rank + HALF_RANK).
    Characters without a piece are spelled in bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text = [b""] * self.size
        self.byte = np.zeros(256, np.int64)
        plain: list[tuple[str, int]] = []
        for n in range(self.size):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                value = int(piece[1:-1], 16)
                self.byte[value], self.text[n] = n, bytes([value])
            elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
                piece = piece.replace("▁", " ")
                self.text[n] = piece.encode()
                plain.append((piece, n))
        weight = {n: 1 / (rank + HALF_RANK) for rank, (_, n) in enumerate(plain)}
        total = sum(weight.values())
        self.byte_cost = math.log(1 / (len(plain) + HALF_RANK) / total)
        children: dict[tuple[int, str], int] = {}
        piece_of: dict[int, int] = {}
        for piece, n in plain:
            node = 0
            for char in piece:
                node = children.setdefault((node, char), len(children) + 1)
            piece_of[node] = n
        edge = sorted((node << 21 | ord(char), child) for (node, char), child in children.items())
        self.codes = np.array([e for e, _ in edge], np.int64)
        self.child = np.array([c for _, c in edge], np.int32)
        # Common characters have a table by inner node: row 0 is for nodes without children.
        inner = np.unique(self.codes >> 21)
        self.row = np.zeros(len(children) + 1, np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.table = np.zeros((len(inner) + 1, COMMON), np.int32)
        common = (self.codes & 0x1FFFFF) < COMMON
        self.table[self.row[self.codes[common] >> 21], self.codes[common] & 0x1FFFFF] = self.child[common]
        self.piece = np.full(len(children) + 1, -1, np.int32)
        self.cost = np.zeros(len(children) + 1)
        for node, n in piece_of.items():
            self.piece[node], self.cost[node] = n, math.log(weight[n] / total)

    def children(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The trie nodes that characters lead to; 0 where no piece goes on."""
        out = self.table[self.row[node], np.minimum(point, COMMON - 1)]
        odd = np.flatnonzero(point >= COMMON - 1)
        if len(odd):
            code = node[odd].astype(np.int64) << 21 | point[odd]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[odd] = np.where(self.codes[place] == code, self.child[place], 0)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        return b"".join(map(self.text.__getitem__, ids)).decode()[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Edges:
    """The edges of new units' lattices by source position, with conditional log probabilities and cumulated chances.

    Positions of a unit follow each other. Edge ids from the vocabulary's size on stand for a character spelled in bytes.
    """

    def __init__(self, units: list[str], pieces: Vocabulary):
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int32)
        sizes = np.array([len(u) for u in units], np.int64)
        self.start = np.cumsum(sizes) - sizes
        left = np.repeat(self.start + sizes, sizes) - np.arange(len(points))
        sources, lengths, ids, costs = [], [], [], []
        at, node = np.arange(len(points), dtype=np.int32), np.zeros(len(points), np.int32)
        spelled = np.ones(len(points), bool)
        length = 0
        while len(at):
            node = pieces.children(node, points[at + length])
            length += 1
            piece = pieces.piece[node]
            ends = np.flatnonzero((piece >= 0) & (node > 0))
            if length == 1:
                spelled[at[ends]] = False
            sources.append(at[ends])
            lengths.append(np.full(len(ends), length, np.int32))
            ids.append(piece[ends])
            costs.append(pieces.cost[node[ends]])
            more = np.flatnonzero((node > 0) & (left[at] > length))
            at, node = at[more], node[more]
        odd = np.flatnonzero(spelled)
        point = points[odd]
        n_bytes = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        sources.append(odd)
        lengths.append(np.ones(len(odd), np.int64))
        ids.append(np.where(point < 0x80, pieces.byte[np.minimum(point, 0x7F)], pieces.size + point))
        costs.append(n_bytes * pieces.byte_cost)
        source, length = np.concatenate(sources), np.concatenate(lengths)
        order = np.argsort(source, kind="stable")
        self.source = source[order]
        self.id, cost = np.concatenate(ids)[order], np.concatenate(costs)[order]
        first = np.searchsorted(self.source, np.arange(len(points) + 1))
        self.target = self.source + length[order]
        ending = left[self.source] == length[order]
        mass = np.zeros(len(points) + 1)
        # Positions by what is left of their unit: all targets are summed before their sources.
        by_rest = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_rest], np.arange(1, int(left.max(initial=0)) + 2))
        for low, high in zip(cuts, cuts[1:]):
            p = by_rest[low:high]
            count = first[p + 1] - first[p]
            head = np.cumsum(count) - count
            e = np.arange(count.sum()) - np.repeat(head, count) + np.repeat(first[p], count)
            value = cost[e] + np.where(ending[e], 0.0, mass[self.target[e]])
            top = np.maximum.reduceat(value, head)
            mass[p] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), head))
        self.log_p = cost + np.where(ending, 0.0, mass[self.target]) - mass[self.source]
        share = np.exp(self.log_p)
        # What an edge leaves to its siblings: those of an edge above one half are added up, so that small sums stay exact.
        minor = np.where(share > 0.5, 0.0, share)
        others = np.add.reduceat(minor, first[:-1])[self.source] if len(share) else share
        with np.errstate(divide="ignore"):
            self.log_rest = np.where(share > 0.5, np.log(others), np.log1p(-minor))
        cumulated = np.cumsum(share)
        # Cumulated chances as fractions of 2^32; the last edge of a position takes the rest.
        self.chance = np.clip((cumulated - np.r_[0.0, cumulated][first[self.source]]) * 2.0 ** 32, 0, _TOP)
        self.chance[first[1:] - 1] = _TOP
        self.first, self.sizes = first[:-1], sizes


class _Numbers(dict):
    """Numbers of units in the order they are met; new ones wait in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number


class Lattices:
    """The lattices of all units a worker remembers: edges `first[p]` to `first[p + 1]` leave position p."""

    def __init__(self, pieces: Vocabulary):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.start, self.end, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int32)
        self.target, self.id = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.log_p, self.log_rest, self.chance = np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros(0, np.uint32)

    def numbers(self, rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all rows and where each row's start; the lattices of units not met before are built."""
        if len(self.number) > KEPT_UNITS or len(self.first) > KEPT_POSITIONS:
            self._clear()
        units = [units_of(t) if t is not None else [] for t in rows]
        starts = np.r_[0, np.cumsum([len(u) for u in units])]
        out = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int32, int(starts[-1]))
        if self.number.new:
            more, shift, edges = _Edges(self.number.new, self.pieces), len(self.first) - 1, len(self.target)
            join = lambda old, new: np.concatenate([old, new.astype(old.dtype)])
            self.start, self.end = join(self.start, more.start + shift), join(self.end, more.start + more.sizes + shift)
            self.first = np.concatenate([self.first[:-1], (more.first + edges).astype(np.int32), [np.int32(edges + len(more.target))]])
            self.target, self.id = join(self.target, more.target + shift), join(self.id, more.id)
            self.log_p, self.log_rest, self.chance = join(self.log_p, more.log_p), join(self.log_rest, more.log_rest), join(self.chance, more.chance)
            self.number.new = []
        return out, starts

    def walk(self, unit: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled path through each unit of a sequence: all edges in order, and where each unit's begin."""
        at, end = self.start[unit], self.end[unit]
        active, steps = np.arange(len(unit)), []
        with np.errstate(over="ignore"):
            while len(active):
                draw = (texts.mix(state + np.uint64(len(steps) + 1) * _STEP) >> np.uint64(32)).astype(np.uint32)
                edge = self.first[at]
                later = np.flatnonzero(draw > self.chance[edge])
                while len(later):
                    edge[later] += 1
                    later = later[draw[later] > self.chance[edge[later]]]
                steps.append((active, edge))
                at = self.target[edge]
                more = np.flatnonzero(at < end)
                active, at, end, state = active[more], at[more], end[more], state[more]
        count = np.zeros(len(unit), np.int64)
        for chosen, _ in steps:
            count[chosen] += 1
        begin = np.r_[0, np.cumsum(count)]
        path = np.empty(int(begin[-1]), np.int32)
        for n, (chosen, edge) in enumerate(steps):
            path[begin[chosen] + n] = edge
        return path, begin


#: A unit: a run of spaces with the word behind it, or a line end with the word behind it.
_UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*")


def units_of(text: str) -> list[str]:
    """The units of a text, which is taken to begin with a space."""
    return _UNIT.findall(" " + text)


def _uniform(key: int, stream: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        state = np.uint64(key) + np.uint64(stream) * _ROW + np.arange(1, n + 1, dtype=np.uint64) * _STEP
        return ((texts.mix(state) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _one_uniform(key: int, stream: int) -> float:
    """The first of `_uniform`, in plain integers: numpy takes far longer for a single number."""
    x = key + stream * int(_ROW) + int(_STEP) & _WORD
    x = (x ^ x >> 30) * _MIXES[0] & _WORD
    x = (x ^ x >> 27) * _MIXES[1] & _WORD
    return ((x ^ x >> 31) >> 11) * 2.0 ** -53 + 2.0 ** -54


class _Search:
    """The perturbed A* search of one row; `paths` are k independent walks (edges, begin of each unit's).

    The first walk is the first sample. Along a sample, the siblings of each step form a node whose bound is drawn below the
    sample's own value; the best node is opened by choosing one of its edges, which begins the next sample, and what remains
    of it goes back. Only the k + 1 best nodes of a sample can ever be needed.
    """

    def __init__(self, lattice: Lattices, units: np.ndarray, paths: list[tuple[np.ndarray, np.ndarray]], key: int, k: int):
        self.lattice, self.units, self.paths, self.key, self.k = lattice, units, paths, key, k
        self.heap: list = []
        #: Edges of each sample, and where its units begin among them.
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.streams = 0

    def _draws(self, n: int) -> np.ndarray:
        self.streams += 1
        return _uniform(self.key, self.streams, n)

    def _draw(self) -> float:
        self.streams += 1
        return _one_uniform(self.key, self.streams)

    def _chosen(self, options: range, closed: tuple[int, ...] = ()) -> tuple[int, float]:
        """An edge drawn by chance from those not closed, and the chance that is left without it."""
        weights = [0.0 if e in closed else math.exp(w) for e, w in zip(options, self.lattice.log_p[options.start:options.stop].tolist())]
        total = sum(weights)
        rest = self._draw() * total
        for n, w in enumerate(weights):
            rest -= w
            if w and rest < 0:
                break
        else:
            n = max(i for i, w in enumerate(weights) if w)
        return options[n], sum(weights[:n]) + sum(weights[n + 1:])

    def _nodes(self, step: int, mass: float, limit: float) -> None:
        """Pushes the best nodes along the newest sample from a step on; `mass` is the log probability before it."""
        (edges, _), path, size = self.found[-1], len(self.found) - 1, 256
        best: list = []
        while step < len(edges):
            part = edges[step:step + size]
            log_p = self.lattice.log_p[part].astype(np.float64)
            after = mass + np.cumsum(log_p)
            place = after - log_p + self.lattice.log_rest[part]
            value = -np.logaddexp(-limit, np.log(-np.log(self._draws(len(part)))) - place)
            top = np.argpartition(-value, self.k)[:self.k + 1] if len(value) > self.k + 1 else np.arange(len(value))
            best += [(-float(value[n]), self.streams, path, step + n, float(after[n] - log_p[n]), (int(part[n]),)) for n in top.tolist() if value[n] > -np.inf]
            best = sorted(best)[:self.k + 1]
            step, mass, size = step + len(part), float(after[-1]), 2 * size
            if len(best) > self.k and mass + NEGLIGIBLE < -best[-1][0]:
                break
        for node in best:
            heapq.heappush(self.heap, node)

    def _open(self) -> None:
        """Begins a sample from the best node."""
        lattice = self.lattice
        value, _, path, step, mass, closed = heapq.heappop(self.heap)
        before, begins = self.found[path]
        position = int(np.searchsorted(lattice.first, np.int32(closed[0]), "right")) - 1
        edge, left = self._chosen(range(int(lattice.first[position]), int(lattice.first[position + 1])), closed)
        if left > 0:
            bound = -np.logaddexp(value, math.log(-math.log(self._draw())) - mass - math.log(left))
            heapq.heappush(self.heap, (-float(bound), self.streams, path, step, mass, (*closed, edge)))
        # The rest of the unit, then the units after it from this sample's own walk.
        unit = int(np.searchsorted(begins, step, "right")) - 1
        end = int(lattice.end[self.units[unit]])
        inside, at = [edge], int(lattice.target[edge])
        while at < end:
            inside.append(self._chosen(range(int(lattice.first[at]), int(lattice.first[at + 1])))[0])
            at = int(lattice.target[inside[-1]])
        edges, own = self.paths[len(self.found)]
        shift = step + len(inside) - own[unit + 1]
        self.found.append((np.concatenate([before[:step], np.array(inside, np.int32), edges[own[unit + 1]:]]),
                           np.concatenate([begins[:unit + 1], own[unit + 1:] + shift])))
        self._nodes(step + 1, mass + float(lattice.log_p[edge]), -value)

    def run(self) -> list[tuple[np.ndarray, float, float]]:
        """(edges, log probability, log inclusion probability) of each sample."""
        bound = -math.log(-math.log(self._draw()))
        self.found.append(self.paths[0])
        self._nodes(0, 0.0, bound)
        while len(self.found) < self.k and self.heap:
            self._open()
        threshold = -self.heap[0][0] if self.heap else -math.inf
        out = []
        for edges, _ in self.found:
            log_p = float(self.lattice.log_p[edges].sum(dtype=np.float64))
            gap = log_p - threshold
            # log(1 - exp(-exp(gap))): the chance that this one's perturbed value exceeds the threshold
            out.append((edges, log_p, 0.0 if gap > 3.6 else math.log(-math.expm1(-math.exp(gap))) if gap > -30 else gap))
        return out


def _ids(lattice: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids of edges, in which characters without a piece are spelled in bytes."""
    ids, pieces = lattice.id[edges], lattice.pieces
    odd = np.flatnonzero(ids >= pieces.size)
    if not len(odd):
        return ids
    spelled = [pieces.byte[list(chr(int(i) - pieces.size).encode())] for i in ids[odd]]
    parts, at = [], 0
    for n, s in zip(odd, spelled):
        parts += [ids[at:n], s]
        at = n + 1
    return np.concatenate([*parts, ids[at:]])


def sample(rows: list[str | None], keys: np.ndarray, lattice: Lattices, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per row up to k distinct segmentations: piece ids, log probability, logarithm of the inclusion probability."""
    flat, starts = lattice.numbers(rows)
    own = np.repeat(keys, np.diff(starts))
    nth = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
    walks = []
    with np.errstate(over="ignore"):
        keys = keys + np.uint64(seed) * _STEP
        for j in range(k):
            walks.append(lattice.walk(flat, texts.mix(own + np.uint64(seed * 1000 + j) * _ROW + nth.astype(np.uint64) * _STEP)))
    out = []
    for n, text in enumerate(rows):
        if text is None:
            out.append([])
            continue
        low, high = starts[n], starts[n + 1]
        paths = [(path[begin[low]:begin[high]], begin[low:high + 1] - begin[low]) for path, begin in walks]
        found = _Search(lattice, flat[low:high], paths, int(keys[n]), k).run()
        out.append([(_ids(lattice, edges), p, q) for edges, p, q in found])
    return out


@lru_cache(maxsize=2)
def lattices(path: str) -> Lattices:
    return Lattices(vocabulary(path))


#: Rows whose lattices are built together.
CHUNK_ROWS, CHUNK_CHARS = 400, 1_500_000

_SAMPLES = "samples array<struct<ids:array<int>,log_probability:double,log_inclusion:double>>"


def _chunks(rows: list[str | None]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for n, text in enumerate(rows):
        size += len(text or "")
        if n + 1 - low >= CHUNK_ROWS or size >= CHUNK_CHARS or n + 1 == len(rows):
            yield low, n + 1
            low, size = n + 1, 0


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SAMPLES, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """(id, samples): up to k distinct segmentations of each whole text, as drawn: ids, log probability, log inclusion.

    A text has fewer samples only if it has fewer segmentations. An empty text has the one of the leading space; a null
    text has none. Draws are seeded by the id, so rows repeated under one id with one text get equal samples; rows
    with null ids draw by text alone.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattices(path)
        for batch in rows:
            column = batch.column(2).to_pylist()
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for low, high in _chunks(column):
                found = sample(column[low:high], keys[low:high], lattice, k, seed)
                each = [s for row in found for s in row]
                offsets = np.r_[0, np.cumsum([len(s[0]) for s in each])].astype(np.int32)
                ids = np.concatenate([s[0] for s in each]).astype(np.int32) if each else np.zeros(0, np.int32)
                structs = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([s[1] for s in each], pa.float64()),
                     pa.array([s[2] for s in each], pa.float64())], ["ids", "log_probability", "log_inclusion"])
                heads = np.r_[0, np.cumsum([len(row) for row in found])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(heads), structs)],
                                                 ["id", "samples"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(id_column).cast("string")).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(batches, f"id {texts.kind(docs, id_column)}, {_SAMPLES}")


def decode(encoded: DataFrame, column: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """`encoded` with `text`, the text of the segmentation in `column`; null gives null."""
    @F.pandas_udf("string")
    def joined(ids: pd.Series) -> pd.Series:
        pieces = vocabulary(path)
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return encoded.withColumn("text", joined(column))
