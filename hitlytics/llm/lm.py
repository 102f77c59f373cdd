"""Language-model scores: a small causal self-attention model over subword ids.

Words are split into subwords of a public byte-pair vocabulary. The model, one attention head trained in numpy, predicts the
class of the next subword from those before it; the subword's share of its class, given the subword before, comes from counts
over all training documents. A class holds either subwords that begin a word or inner ones, so that the probabilities of all
next subwords sum to one. Documents are cut into overlapping windows of CONTEXT + SCORED positions, batched over documents;
each subword is scored once, with at least CONTEXT positions before it in view.

The model is trained on all training documents, whole. Texts are split into subwords once, where they are, and kept as packed ids;
each partition is a shard. A hash deals its documents to the rounds: tasks train on one shard's documents of the round each, all
from the same parameters, which are averaged after the round and sent out again.

Beside it stands a unigram base over words. Words that make up more than a FREQUENT-th of the training tokens, of which
there are fewer than FREQUENT, are broadcast as sorted hashes; all others are joined.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlytics.llm import texts

#: Vocabulary file of (base64 subword, rank) lines.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r" ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+"

#: Share of the documents in a sample for trials, and how many it holds in small corpora; scores are never learned from one.
SHARE, LEAST_DOCS = 1 / 32, 1200
#: Text bytes of a sample's shard, rounds of averaging, tasks that add up the shards' parameters.
SHARD_BYTES, ROUNDS, ADDERS = 4 << 20, 4, 8
CLASSES, WIDTH, CONTEXT, SCORED = 32, 16, 8, 16
#: Subwords with an embedding of their own, the most frequent ones; the others share that of their class.
EMBEDDED = 2048
#: Subwords that are clustered by their neighbours, the most frequent ones, and the neighbours that are told apart.
CLUSTERED, MARKS = 8192, 128
#: Subwords that are buckets of their own as the one before; the weight, in subwords, of the share over all buckets.
OWN_BUCKETS, PRIOR = 128, 5.0
#: Pairs of subwords within words that have a share of their own: those that make up more than a PAIRS-th of all, fewer than PAIRS.
PAIRS = 1 << 21
#: Steps over all rounds of a shard with few windows (others see each window once), windows of a step, rate.
STEPS, BATCH, RATE = 1000, 256, 0.02
FREQUENT = 1 << 20
#: Text bytes that are split together, rows that are scored together.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 400
#: Windows that one attention batch takes, and rows that enter a product together: those of this size stay in one thread, as tasks
#: already fill the cores (two threads double the CPU seconds and save no time).
WINDOWS, BLOCK = 64, 512
#: Different words that a counting task gathers before it passes them on.
GATHERED = 1_000_000

END_HASH = np.uint64(0xE0F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(texts.SPACES)] = True


# Subwords

class Subwords:
    """Subword ids of words, of which different ones are split once in a chunk; END is the id of the end and of the start."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("subwords", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end, self.size = len(ranks), len(ranks) + 1
        self.begins = np.ones(self.size, bool)
        self.begins[list(ranks.values())] = [piece.startswith(b" ") for piece in ranks]

    def split(self, word: bytes) -> list[int]:
        return self._encode(" " + word.decode())

    def split_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has.

        Words are split in one call, as no piece crosses the space between two of them; those that hold white space beyond ASCII,
        with which such a space could form a piece, are split by themselves.
        """
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_py()
        if " ".join(joined.split()) == joined:
            ids = np.array(self._encode(" " + joined) if len(words) else [], np.int32)
            return ids, np.diff(np.r_[np.flatnonzero(self.begins[ids]), len(ids)])
        spelled = np.array(joined.split(" "), object)
        plain = np.array([w.split() == [w] for w in spelled], bool)
        alone = [self._encode(" " + w) for w in spelled[~plain]]
        together, of_plain = self.split_all(pa.array(spelled[plain], pa.string()))
        sizes = np.empty(len(spelled), np.int64)
        sizes[plain], sizes[~plain] = of_plain, [len(f) for f in alone]
        ids, mark = np.empty(int(sizes.sum()), np.int32), np.repeat(plain, sizes)
        ids[mark], ids[~mark] = together, [i for f in alone for i in f]
        return ids, sizes

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows' words, each row closed by END, and where each row starts."""
        ids, sizes = self.split_all(words.spelled())
        first, size = (np.cumsum(sizes) - sizes).astype(np.int32)[words.of], sizes.astype(np.int32)[words.of]
        word_at = np.r_[0, np.cumsum(size)].astype(np.int32)
        starts = np.r_[0, word_at[np.cumsum(words.per_row)] + np.arange(1, len(words.per_row) + 1)]
        out = np.full(int(starts[-1]), self.end, np.int32)
        at = np.arange(word_at[-1], dtype=np.int32)
        out[at + np.repeat(words.row.astype(np.int32), size)] = ids[at + np.repeat(first - word_at[:-1], size)]
        return out, starts

    def sequences(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The same of rows of words."""
        return self.of_words(Words(pa.array([b" ".join(words).decode() for words in rows], pa.string())))


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words between ASCII white space."""
    return (text or "").encode().lower().split()


# Counts over the corpus

class Words:
    """The lower-cased words of a column of texts: their rows, the different ones' hashes, which of these each one is, counts per row."""

    def __init__(self, column: pa.Array):
        data, offsets = texts.flat(column)
        self._data = _LOWER[data]
        self._starts, self._ends, self.row = texts.word_spans(~_IS_SPACE[self._data], offsets)
        hashes = texts.span_hashes(self._data, self._starts, self._ends)
        hashes[hashes == END_HASH] += np.uint64(1)
        self.of, self.different = pd.factorize(hashes)
        self.per_row = np.bincount(self.row, minlength=len(column))

    def spelled(self) -> pa.Array:
        """The different words."""
        first = _firsts(self.of, len(self.different))
        starts, size = self._starts[first], self._ends[first] - self._starts[first]
        at = np.r_[0, np.cumsum(size)]
        data = self._data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _firsts(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of n values occurs first."""
    first = np.empty(n, np.int64)
    first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    return first


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, but for the first, hold less than CHUNK_BYTES."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(low, high - low) for low, high in zip(cuts, cuts[1:]) if high > low)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words with their counts, gathered over batches until there are GATHERED of them."""
    gathered: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        hashes, counts, words = zip(*gathered)
        of, different = pd.factorize(np.concatenate(hashes))
        sums = np.zeros(len(different), np.int64)
        np.add.at(sums, of, np.concatenate(counts))
        return different, sums, pa.concat_arrays(words).take(pa.array(_firsts(of, len(different))))

    def rows() -> pa.RecordBatch:
        _, counts, words = merged()
        return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(counts)], ["word", "n"])

    for batch in _chunks(batches, 0):
        words = Words(batch.column(0))
        gathered.append((words.different, np.bincount(words.of, minlength=len(words.different)), words.spelled()))
        if sum(len(g[0]) for g in gathered) > GATHERED:
            gathered = [merged()]
            if len(gathered[0][0]) > GATHERED // 2:
                yield rows()
                gathered = []
    if gathered:
        yield rows()


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(word, n) over all texts; null texts have no words."""
    return docs.select(F.col(text_column).alias("text")).mapInArrow(_count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(words: DataFrame, path: str) -> DataFrame:
    """(code, n) of subword pairs over all words, from the counted different words.

    The code is the subword before times the vocabulary's size plus the subword; before first ones stands that size.
    """
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in rows:
                ids, size = coder.split_all(batch.column(0))
                before = np.r_[ids[-1:], ids[:-1]].astype(np.int64)
                before[(np.cumsum(size) - size)[size > 0]] = coder.size
                yield before * coder.size + ids, np.repeat(batch.column(1).to_numpy(), size)

        yield from added_up(pairs())

    return words.select("word", "n").mapInArrow(batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def added_up(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(code, n) rows, those of equal codes added up; GATHERED different codes are passed on at a time."""
    gathered: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(p) for p in zip(*gathered))
        found, inverse = np.unique(codes, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, inverse, counts)
        return found, sums

    for part in parts:
        gathered.append(part)
        if sum(len(g[0]) for g in gathered) > GATHERED:
            gathered = [merged()]
            if len(gathered[0][0]) > GATHERED // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in gathered[0]], ["code", "n"])
                gathered = []
    if gathered:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["code", "n"])


def bucket_counts(pairs: DataFrame, bucket_of: np.ndarray) -> np.ndarray:
    """Counts (bucket of the subword before, subword) of all pairs; first ones have the last bucket."""
    size, buckets = len(bucket_of), int(bucket_of.max()) + 2
    bucket = np.r_[bucket_of, buckets - 1]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = ((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in rows)
        yield from added_up((bucket[c // size] * size + c % size, n) for c, n in codes)

    # At most as many rows as there are buckets times subwords, of which few occur.
    found = pairs.select("code", "n").mapInArrow(batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets * size, np.float32)
    out[found["code"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out.reshape(buckets, -1)


def frequent_pairs(pairs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, sorted, and counts of the fewer than PAIRS pairs within words that make up more than a PAIRS-th of all."""
    inner = pairs.filter(F.col("code") < size * size)
    total = inner.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = inner.filter(F.col("n") * PAIRS > total).toPandas()
    codes, counts = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    order = np.argsort(codes)
    return codes[order], counts[order]


# The attention model

@dataclass
class Attention:
    """Tables by input symbol of queries, keys and values, the bias by distance, and the output layer."""

    parameters: dict[str, np.ndarray]
    symbol: np.ndarray
    class_of: np.ndarray
    #: Bucket of a subword as the one before, and which subwords begin a word; log share of a class by bucket and subword.
    bucket_of: np.ndarray
    begins: np.ndarray
    share: np.ndarray
    #: Codes of frequent pairs, sorted, and their log shares; by subword before and class, the log share left to all others.
    pairs: np.ndarray
    pair_share: np.ndarray
    left: np.ndarray

    def shares(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log share of each subword in its class, given the one before it."""
        inner = ~self.begins[ids]
        out = self.share[np.where(inner, self.bucket_of[before], len(self.share) - 1), ids]
        if len(self.pairs):
            before, ids = before[inner], ids[inner]
            of, code = pd.factorize(before.astype(np.int64) * len(self.class_of) + ids)
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            before, ids = np.divmod(code, len(self.class_of))
            rest = self.share[self.bucket_of[before], ids] + self.left[before, self.class_of[ids]]
            out[inner] = np.where(self.pairs[at] == code, self.pair_share[at], rest)[of]
        return out

    def tables(self) -> tuple[np.ndarray, ...]:
        """The last symbol is padding: its value, and its weight in the last column of the values, is zero."""
        p = self.parameters
        scale = np.float32(1 / math.sqrt(WIDTH))
        pad = lambda t: np.vstack([t, np.zeros((1, t.shape[1]), np.float32)])
        values = np.hstack([p["e"] @ p["v"] @ p["o"], np.ones((len(p["e"]), 1), np.float32)])
        return pad(p["e"] @ p["q"] * scale), pad(p["e"] @ p["k"]), pad(values), pad(p["e"] @ p["s"])

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each row of ids given by its start."""
        q, k, v, own = self.tables()
        total = np.zeros(len(starts) - 1)
        before = np.r_[ids[-1:], ids[:-1]]
        before[starts[:-1]] = self.symbol.size - 1  # every row starts with END
        row_of, place, spread = _padded(starts)
        inputs, class_of = spread(self.symbol[before], len(q) - 1), spread(self.class_of[ids], CLASSES)
        share = spread(self.shares(before, ids), np.float32(0))
        near = np.exp(_bias(self.parameters["b"])) * _CAUSAL
        wide = np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() > 60
        ones = np.ones((CLASSES, 1), np.float32)
        for low in range(0, len(place), WINDOWS):
            part = inputs[place[low:low + WINDOWS]]
            asked = part[:, CONTEXT:].ravel()
            target = class_of[place[low:low + WINDOWS], CONTEXT:].ravel()
            weights = np.take(q, asked, axis=0).reshape(len(part), SCORED, WIDTH) @ np.take(k, part, axis=0).transpose(0, 2, 1)
            if wide:
                np.clip(weights, -60, 60, out=weights)
            np.exp(weights, out=weights)
            weights *= near
            seen = weights @ np.take(v, part, axis=0)
            hidden = seen[..., :-1] / np.maximum(seen[..., -1:], np.float32(1e-30))
            hidden += np.take(own, asked, axis=0).reshape(hidden.shape)
            np.maximum(hidden, 0, out=hidden)
            logits = _blocks(hidden) @ self.parameters["u"]
            logits += self.parameters["c"]
            picked = np.take(logits, np.arange(0, logits.size, CLASSES) + np.minimum(target, CLASSES - 1))
            np.exp(logits, out=logits)
            picked -= np.log(logits @ ones).ravel()
            picked += share[place[low:low + WINDOWS], CONTEXT:].ravel()
            picked *= target < CLASSES
            total += np.bincount(row_of[low:low + WINDOWS], picked.reshape(-1, SCORED).sum(1, dtype=np.float64), len(total))
        return total / math.log(10)


_CAUSAL = (np.arange(CONTEXT + SCORED) <= np.arange(SCORED)[:, None] + CONTEXT).astype(np.float32)


def _bias(by_distance: np.ndarray) -> np.ndarray:
    distance = np.arange(SCORED)[:, None] + CONTEXT - np.arange(CONTEXT + SCORED)
    return by_distance[np.clip(distance, 0, CONTEXT + SCORED - 1)]


def _padded(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, float], np.ndarray]]:
    """Row of every window, its number among all windows of padded values, and what pads values and cuts them into these windows.

    Before a row stand CONTEXT positions of padding, behind it as many as fill its last window; the last SCORED of a window are scored.
    """
    counts = -(-np.diff(starts) // SCORED)
    row_of = np.repeat(np.arange(len(counts)), counts)
    size = counts * SCORED + CONTEXT
    first = np.cumsum(size) - size
    place = first[row_of] + (np.arange(len(row_of)) - (np.cumsum(counts) - counts)[row_of]) * SCORED
    at = np.arange(starts[-1]) + np.repeat(first + CONTEXT - starts[:-1], np.diff(starts))

    def spread(values: np.ndarray, padding: float) -> np.ndarray:
        out = np.full(max(CONTEXT + SCORED, int(size.sum())), padding, values.dtype)
        out[at] = values
        return np.lib.stride_tricks.sliding_window_view(out, CONTEXT + SCORED)

    return row_of, place, spread


def _frequent(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords that are clustered, and those that are told apart as their neighbours."""
    ranked = np.argsort(-counts, kind="stable")
    often = ranked[:CLUSTERED]
    often = np.sort(often[counts[often] >= 5])
    return often[often != len(counts) - 1], ranked[:MARKS]


def neighbour_counts(encoded: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often each clustered subword has each mark before it (first half of the columns) and after it."""
    often, marks = _frequent(counts)
    end, rows, width = len(counts) - 1, len(often) + 1, len(marks) + 1
    mark, place = np.full(len(counts), width - 1), np.full(len(counts), rows - 1)  # the last ones take what is not told apart
    mark[marks], place[often] = np.arange(len(marks)), np.arange(len(often))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * rows * width, np.int64)
        for batch in batches:
            ids = np.r_[end, _ids(batch.column(1), len(counts))[0]]  # every row ends with END, which stands before the next
            here, there = place[ids] * width, mark[ids]
            total[:rows * width] += np.bincount(here[1:] + there[:-1], minlength=rows * width)
            total[rows * width:] += np.bincount(here[:-1] + there[1:], minlength=rows * width)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    # At most about CLUSTERED times 2 MARKS rows, of which few occur.
    found = encoded.mapInArrow(codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(2 * rows * width)
    out[found["code"].to_numpy(np.int64)] = found["n"].to_numpy()
    return np.hstack(out.reshape(2, rows, width)[:, :-1, :-1])


def _classes(counts: np.ndarray, neighbours: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Class of every subword: frequent ones are clustered by their neighbours, END and the rare ones have their own.

    No class holds both subwords that begin a word and inner ones: their shares come from different counts, and each of these
    sums to one over a class.
    """
    often, _ = _frequent(counts)
    out = np.where(begins, CLASSES - 1, CLASSES - 3)
    if len(often):
        view = np.sqrt(neighbours / np.maximum(neighbours.sum(1, keepdims=True), 1))
        ranked = np.argsort(-counts[often], kind="stable")
        first = begins[often]
        seeds = ranked[:CLASSES - 3]
        for kind in (True, False):
            if (first == kind).any() and not (first[seeds] == kind).any():
                seeds = np.r_[seeds[:CLASSES - 4], ranked[first[ranked] == kind][0]]
        centers = view[seeds].copy()
        other = first[:, None] != first[seeds]
        weight = counts[often].astype(float)
        for _ in range(15):
            near = np.where(other, -np.inf, view @ centers.T * 2 - (centers ** 2).sum(1)).argmax(1)
            for c in range(len(centers)):
                if (near == c).any():
                    centers[c] = np.average(view[near == c], axis=0, weights=weight[near == c])
        out[often] = near
    out[len(counts) - 1] = CLASSES - 2
    return out


_SHAPES = {"e": (EMBEDDED + CLASSES, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
           "s": (WIDTH, WIDTH), "b": (CONTEXT + SCORED,), "u": (WIDTH, CLASSES), "c": (CLASSES,)}


def _views(state: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Parameters and their first and second moments as views of one array."""
    at, out = 0, []
    for _ in range(3):
        out.append({})
        for name, shape in _SHAPES.items():
            out[-1][name] = state[at:at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
    return out


def _start() -> np.ndarray:
    random = np.random.default_rng(7)
    state = np.zeros(3 * sum(map(math.prod, _SHAPES.values())), np.float32)
    for name, own in _views(state)[0].items():
        own[:] = random.normal(0, 0 if name in "bc" else 1 if name == "e" else 1 / math.sqrt(WIDTH), own.shape)
    return state


def _blocks(rows: np.ndarray) -> np.ndarray:
    """Rows in blocks whose products with a layer stay in one thread."""
    n = math.prod(rows.shape[:-1])
    return rows.reshape(-1, BLOCK if n % BLOCK == 0 else 8, rows.shape[-1])


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of the transposed rows of a and the rows of b."""
    return (_blocks(a).transpose(0, 2, 1) @ _blocks(b)).sum(0)


def _added_rows(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each of n places."""
    width = rows.shape[1]
    return np.bincount((place[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).astype(np.float32).reshape(n, width)


def _train(state: np.ndarray, number: int, steps: int, ids: np.ndarray, starts: np.ndarray, symbol: np.ndarray, class_of: np.ndarray) -> None:
    """One round, of this number, over all windows of a shard, in at least `steps` steps; changes the state."""
    random = np.random.default_rng([7, number, int(ids[:64].sum()), len(ids)])
    p, (flat, first, second) = _views(state)[0], np.split(state, 3)
    gradient = np.zeros_like(state)
    g, gradient = _views(gradient)[0], np.split(gradient, 3)[0]
    inputs = symbol[np.r_[ids[-1:], ids[:-1]]]
    inputs[starts[:-1]] = symbol[-1]  # every row starts with END
    _, place, spread = _padded(starts)
    inputs, targets = spread(inputs, -1), spread(class_of[ids], 0)
    scale = np.float32(1 / math.sqrt(WIDTH))
    keys, classes, width = (np.ones((n, 1), np.float32) for n in (CONTEXT + SCORED, CLASSES, WIDTH))
    distance = np.clip(np.arange(SCORED)[:, None] + CONTEXT - np.arange(CONTEXT + SCORED), 0, CONTEXT + SCORED - 1)
    every = np.ones(BATCH * SCORED, np.float32)
    passes = -(-len(place) // BATCH)
    steps = max(steps, passes)
    for step in range(number * steps + 1, (number + 1) * steps + 1):
        turn = (step - 1) % passes
        if turn == 0 or step == number * steps + 1:
            order = random.permutation(len(place))
        pick = place[order[turn * BATCH:(turn + 1) * BATCH]]
        x, y = inputs[pick], targets[pick, CONTEXT:].ravel()
        ok = x >= 0
        np.maximum(x, 0, out=x)
        n = len(pick)
        weight = (ok[:, CONTEXT:] / np.float32(max(1, np.count_nonzero(ok[:, CONTEXT:])))).reshape(-1, 1)
        # The products of two parameters are taken first: queries with keys, values with the layer they enter.
        asks, gives = p["q"] @ p["k"].T * scale, p["v"] @ p["o"]
        e = np.take(p["e"], x, axis=0)
        eq = np.ascontiguousarray(e[:, CONTEXT:])
        both = (_blocks(eq) @ np.hstack([asks, p["s"]])).reshape(n, SCORED, 2 * WIDTH)
        asked = both[..., :WIDTH]
        a = asked @ e.transpose(0, 2, 1)
        a += p["b"][distance]
        np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= _CAUSAL
        a *= ok[:, None, :]
        a /= np.maximum(_blocks(a) @ keys, np.float32(1e-30)).reshape(n, SCORED, 1)
        seen = a @ e
        h = (_blocks(seen) @ gives).reshape(seen.shape)
        h += both[..., WIDTH:]
        np.maximum(h, 0, out=h)
        d = (_blocks(h) @ p["u"]).reshape(-1, CLASSES)
        d += p["c"]
        np.clip(d, -60, 60, out=d)
        np.exp(d, out=d)
        d *= weight / (_blocks(d) @ classes).reshape(-1, 1)
        d.ravel()[np.arange(0, d.size, CLASSES) + y] -= weight.ravel()
        g["u"][:], g["c"][:] = _summed(h, d), every[:len(d)] @ d
        dboth = np.empty_like(both)
        dh = (_blocks(d) @ p["u"].T).reshape(h.shape)
        dh *= h > 0
        back = (_blocks(dh) @ gives.T).reshape(h.shape)
        da = back @ e.transpose(0, 2, 1)
        da -= (_blocks(back * seen) @ width).reshape(n, SCORED, 1)
        da *= a
        g["b"][:] = np.bincount(distance.ravel(), da.sum(0).ravel(), CONTEXT + SCORED)
        np.matmul(da, e, out=dboth[..., :WIDTH])
        dboth[..., WIDTH:] = dh
        dasks, g["s"][:] = np.hsplit(_summed(eq, dboth), 2)
        dasks, dgives = dasks * scale, _summed(seen, dh)
        g["q"][:], g["k"][:], g["v"][:], g["o"][:] = dasks @ p["k"], dasks.T @ p["q"], dgives @ p["o"].T, p["v"].T @ dgives
        de = da.transpose(0, 2, 1) @ asked
        de += a.transpose(0, 2, 1) @ back
        de[:, CONTEXT:] += (_blocks(dboth) @ np.vstack([asks.T, p["s"].T])).reshape(eq.shape)
        g["e"][:] = _added_rows(x.ravel(), de.reshape(-1, WIDTH), len(p["e"]))
        rate = RATE * min(1.0, 2 * (1 - step / (ROUNDS * steps + 1)))
        first += np.float32(0.1) * (gradient - first)
        second += np.float32(0.01) * (gradient * gradient - second)
        change = np.sqrt(second * np.float32(1 / (1 - 0.99 ** step)))
        change += np.float32(1e-8)
        np.divide(first, change, out=change)
        change *= np.float32(rate / (1 - 0.9 ** step))
        flat -= change


def _packed(ids: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """The ids of each row as bytes; `size` is the vocabulary's."""
    kind = _width(size)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])


def _width(size: int) -> np.dtype:
    return np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)


def _ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after another, and where each row starts; the column holds lists or packed ids."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
    kind, column = _width(size), column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] // kind.itemsize if len(column) else np.zeros(1, np.int64)
    ids = np.frombuffer(data, kind)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, kind)
    return ids.astype(np.int32), at - at[0]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(key, ids) of (key, text) rows; the partitions stay as they are."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path)
        for batch in _chunks(rows, 1):
            ids, starts = coder.of_words(Words(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))], ["key", "ids"])

    return docs.select("key", "text").mapInArrow(batches, "key long, ids array<int>")


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of all states, one at a time, and the sum of their weights."""
    total, weight = 0.0, 0
    for batch in batches:
        for state, n in zip(batch.column(0), batch.column(1).to_pylist()):
            total = total + np.frombuffer(state.as_buffer(), np.float32).astype(np.float64) * n
            weight += n
    if weight:
        yield _state_row((total / weight).astype(np.float32), weight)


def _state_row(state: np.ndarray, weight: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary()), pa.array([weight], pa.int64())], ["state", "n"])


def rounds(shards: DataFrame) -> list[DataFrame]:
    """The rows of each round; a row is in one of them, by its key."""
    return [shards.filter(F.pmod(F.shiftrightunsigned("key", 32), F.lit(ROUNDS)) == number) for number in range(ROUNDS)]


def trained(shards: DataFrame, symbol: np.ndarray, class_of: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS rounds over (key, ids) rows, of which each partition is a shard; the untrained ones without rows."""
    state, context = _start(), shards.sparkSession.sparkContext
    steps, schema = -(-STEPS // ROUNDS), "state binary, n long"
    for number, dealt in enumerate(rounds(shards)):
        sent = context.broadcast((state, symbol, class_of))

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for batch in rows:
                ids, starts = _ids(batch.column(1), len(class_of))
                found += zip(batch.column(0).to_pylist(), np.split(ids, starts[1:-1]))
            if found:
                found.sort(key=lambda row: row[0])  # the same order in every attempt
                starts = np.r_[0, np.cumsum([len(ids) for _, ids in found])]
                own, symbols, classes = sent.value
                own = own.copy()
                _train(own, number, steps, np.concatenate([ids for _, ids in found]), starts, symbols, classes)
                yield _state_row(own, int((-(-np.diff(starts) // SCORED)).sum()))

        rows = dealt.mapInArrow(batches, schema).repartition(ADDERS).mapInArrow(_average, schema).collect()
        if not rows:
            continue
        weights = [r["n"] for r in rows]
        state = np.average([np.frombuffer(r["state"], np.float32).astype(np.float64) for r in rows], axis=0, weights=weights).astype(np.float32)
    return _views(state)[0]


def _shares(counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """log share of each subword in its class, by the bucket before; smoothed by the share over all buckets."""
    plain = counts.sum(0, dtype=np.float64) + 0.5
    plain /= np.bincount(class_of, plain, CLASSES)[class_of]
    out = np.empty_like(counts)
    for bucket, own in enumerate(counts):
        out[bucket] = np.log((own + PRIOR * plain) / (np.bincount(class_of, own, CLASSES)[class_of] + PRIOR))
    return out


def _pair_shares(codes: np.ndarray, counts: np.ndarray, share: np.ndarray, bucket_of: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the pairs, smoothed by the share in the bucket, and what is left to other subwords of the class."""
    before, after = codes // len(class_of), codes % len(class_of)
    total = np.zeros((len(class_of), CLASSES), np.float64)
    np.add.at(total, (before, class_of[after]), counts)
    own = (counts + PRIOR * np.exp(share[bucket_of[before], after])) / (total[before, class_of[after]] + PRIOR)
    return np.log(own).astype(np.float32), np.log(PRIOR / (total + PRIOR)).astype(np.float32)


def fit(shards: DataFrame, words: DataFrame, n_docs: int, path: str) -> Attention:
    """Trains on the (key, ids) rows of `shards`; all counts of subwords come from the word counts of the corpus."""
    coder = subwords(path)
    pairs = texts.checkpointed(pair_counts(words, path))
    # As many rows as there are subwords.
    found = pairs.groupBy((F.col("code") % coder.size).alias("id")).agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(coder.size, np.int64)
    seen[found["id"].to_numpy(np.int64)] = found["n"].to_numpy()
    seen[coder.end] = n_docs
    class_of = _classes(seen, neighbour_counts(shards, seen), coder.begins)
    often = np.argsort(-seen, kind="stable")
    symbol = EMBEDDED + class_of
    symbol[often[:EMBEDDED]] = np.arange(min(EMBEDDED, coder.size))
    symbol[coder.end] = EMBEDDED + class_of[coder.end]
    bucket_of = OWN_BUCKETS + class_of
    bucket_of[often[:OWN_BUCKETS]] = np.arange(OWN_BUCKETS)
    share = _shares(bucket_counts(pairs, bucket_of), class_of)
    codes, counts = frequent_pairs(pairs, coder.size)
    own, left = _pair_shares(codes, counts, share, bucket_of, class_of)
    symbol, class_of, bucket_of = (x.astype(np.int32) for x in (symbol, class_of, bucket_of))
    return Attention(trained(shards, symbol, class_of), symbol, class_of, bucket_of, coder.begins, share, codes, own, left)


def sample(docs: DataFrame, n_docs: int, n_bytes: int, path: str) -> DataFrame:
    """(key, ids) of whole texts, a share of (id, text) rows by hash, dealt to partitions of about SHARD_BYTES. For trials only.

    The share is SHARE, or what gives about LEAST_DOCS documents where that is more; all documents if there are fewer.
    """
    share = max(SHARE, LEAST_DOCS / max(1, n_docs))
    key = F.xxhash64("id", "text")
    chosen = docs.filter(F.pmod(key, F.lit(1 << 32)) < int(share * (1 << 32))).select(key.alias("key"), "text")
    return texts.checkpointed(encoded(chosen.repartition(max(1, math.ceil(min(1.0, share) * n_bytes / SHARD_BYTES))), path))


# Scores

def _coded(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], path: str) -> DataFrame:
    """Per row: its packed ids, the base score by the frequent words, and the other words with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["id", "held_out", "row", "key", "n_tokens", "n_known", "logs", "words", "times", "ids"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        logs = np.log10(counts + 1.0)
        coder = subwords(path)
        for batch in _chunks(rows, 4):
            words = Words(batch.column(4))
            at = np.minimum(np.searchsorted(known, words.different), max(0, len(known) - 1))
            hit = known[at] == words.different if len(known) else np.zeros(len(words.different), bool)
            log = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(hit))
            total = np.bincount(words.row, log[words.of], batch.num_rows).astype(np.float64)  # whole numbers if there are none
            often = hit[words.of]
            n_known = np.bincount(words.row[often], minlength=batch.num_rows)
            rest, times = np.unique(words.row[~often] * len(hit) + words.of[~often], return_counts=True)
            row, which = np.divmod(rest, max(1, len(hit)))
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
            ids, starts = coder.of_words(words)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(words.per_row), pa.array(n_known), pa.array(total),
                 pa.ListArray.from_arrays(offsets, pa.array(words.different[which].view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))), _packed(ids, starts, coder.size)], names)

    return docs.mapInArrow(batches, f"id {texts.kind(docs, 'id')}, held_out boolean, row long, key long, n_tokens long, n_known long, logs double, "
                                    "words array<long>, times array<int>, ids binary")


def _score(coded: DataFrame, model: Attention) -> DataFrame:
    """(row, score) of (row, ids) rows."""
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention = sent.value
        for batch in (b.slice(low, CHUNK_ROWS) for b in rows for low in range(0, b.num_rows, CHUNK_ROWS)):
            score = attention.log10(*_ids(batch.column(1), len(attention.class_of)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["row", "score"])

    return coded.select("row", "ids").mapInArrow(batches, "row long, score double")


def _hashed(words: DataFrame) -> DataFrame:
    """(hash, n) of counted words."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            data, offsets = texts.flat(batch.column(0))
            hashes = texts.span_hashes(data, offsets[:-1], offsets[1:])
            hashes[hashes == END_HASH] += np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(1)], ["hash", "n"])

    return words.select("word", "n").mapInArrow(batches, "hash long, n long")


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    Learns from the rows that `held_out` does not mark; base_score is the sum over tokens (words and one end) of
    log10((c + 1) / (N + V + 1)), score the model's log10 probability of the text. Null and empty texts consist of the end
    alone. Without training rows N and V are 0, and the model is the untrained one. Repeated rows each give a row.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"))
    learned = rows.filter(~F.col("held_out"))
    counts = texts.checkpointed(word_counts(learned, "text"))
    n_docs = learned.count()
    n_words, n_different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_kinds = n_words + n_docs, n_different + (n_docs > 0)
    hashed = _hashed(counts)
    # Fewer than FREQUENT words can each make up more than a FREQUENT-th of all tokens.
    often = hashed.filter(F.col("n") * FREQUENT > n_all).toPandas()
    known, c = often["hash"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(known)
    keyed = rows.select("id", "held_out", "row", F.xxhash64("id", "text").alias("key"), "text")
    coded = texts.checkpointed(_coded(keyed, (known[order], c[order]), vocabulary))
    model = fit(coded.filter(~F.col("held_out")).select("key", "ids"), counts, n_docs, vocabulary)
    scores = texts.checkpointed(_score(coded, model))
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("hash"), F.col("w.times").alias("times"))
    found = rare.join(hashed.filter(F.col("n") * FREQUENT <= n_all), "hash").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    tokens = F.col("n_tokens") + 1
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + math.log10(n_docs + 1.0)
    return coded.drop("words", "times", "ids").join(scores, "row").join(found, "row", "left").select(
        "id", "held_out", tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - tokens * math.log10(n_all + n_kinds + 1)).alias("base_score"), "score")
