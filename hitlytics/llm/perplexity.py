"""Quality by n-gram perplexity under a modified Kneser-Ney model.

The units are the characters themselves of every script, after lower-casing and writing the signs that the base rules count as one;
those from U+7000 on are a pair of units, as in UTF-16, so that an n-gram's code is exact. Spark counts the n-grams of all texts, however many there are, and joins their orders to
probabilities. Of these the frequent ones are broadcast as arrays sorted by code, all others are joined with the texts. Bands
per language around the median log perplexity of its documents reject what is too hard or too easy to predict. The mean over a short text scatters
more than that over a long one, so a band's width follows the length of the text: its variance is one of characters,
divided by their number, plus one between documents, both taken from medians of all documents of the language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlytics import session
from hitlytics.llm import lm, texts

ORDER = 4
SYMBOLS = 1 << 15
#: Characters that are one unit end before this; the first and the second units of the others.
SINGLE, FIRST, SECOND = 0x7000, 0x7000, 0x7800
#: N-grams that make up more than a FREQUENT-th of all, fewer than FREQUENT, are broadcast.
FREQUENT = 1 << 21
#: Steps of a log probability in a nat: sums of whole steps do not depend on the order of rows.
STEPS = 1 << 24
#: Half-width of a band in standard deviations, and the least deviation between documents in nats.
BAND_WIDTH, LEAST_SPREAD = 2.5, 0.01
#: Standard deviations of a normal distribution by its median absolute deviation.
_NORMAL = 1.4826
#: Fixed values of the base rules.
LEAST_WORDS, REPEATED_SHARE, SIGNS = 50, 50, "#*$%&|<>"


_ASCII = np.arange(128)
_ASCII[[ord(c) for c in SIGNS]] = ord(SIGNS[0])


def units(text: str) -> np.ndarray:
    """The units of a text, below SYMBOLS: no two texts have the same that differ in more than capitals and the kind of SIGNS."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points)
    pairs = points >= SINGLE
    if not pairs.any():
        return points
    at = np.arange(len(points)) + np.cumsum(pairs) - pairs
    out = np.empty(len(points) + int(pairs.sum()), np.int64)
    out[at] = np.where(pairs, FIRST + (points >> 11), points)
    out[at[pairs] + 1] = SECOND + (points[pairs] & 0x7FF)
    return out


def codes(text: str | None) -> np.ndarray:
    """The n-gram code that ends at each unit; a text begins and ends with a space."""
    padded = np.r_[np.full(ORDER - 1, ord(" ")), units(f"{text or ''} ")]
    out = np.zeros(len(padded) - ORDER + 1, np.int64)
    for k in range(ORDER):
        out = out * SYMBOLS + padded[k:k + len(out)]
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            found = [codes(text) for text in batch.column(0).to_pylist() if text]
            if found:
                counts = pa.array(np.concatenate(found)).value_counts()
                yield counts.field("values").to_numpy(), counts.field("counts").to_numpy()

    yield from lm.added_up(parts())


def count(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(code, n): n-gram counts over all texts, added up per task before the shuffle."""
    return docs.select(F.col(text_column).alias("text")).mapInArrow(_count_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """What is taken from n-grams seen once, twice and more often, by how many are seen one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), c) for d, c in zip(found, (0.95, 1.9, 2.9))]


def probabilities(counts: DataFrame) -> DataFrame:
    """(code, n, p): the interpolated modified Kneser-Ney probability of the last unit, of all n-grams and that of an empty text.

    From the lowest order, which is interpolated with the uniform distribution, up; lower orders count the different units
    before an n-gram. Every order is a table as long as it has n-grams.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, texts.checkpointed(levels[0].groupBy((F.col("code") % SYMBOLS ** k).alias("code")).agg(F.count("*").alias("n"))))
    out = None
    for k, level in enumerate(levels, 1):
        taken = _discounts(*level.agg(*[F.count(F.when(F.col("n") == c, 1)) for c in (1, 2, 3, 4)]).first())
        level = level.withColumn("taken", F.when(F.col("n") == 1, taken[0]).when(F.col("n") == 2, taken[1]).otherwise(taken[2]))
        context = F.shiftright("code", SYMBOLS.bit_length() - 1).alias("context")
        contexts = level.groupBy(context).agg(F.sum("n").alias("total"), F.sum("taken").alias("left"))
        # The n-gram of an empty text, which is not counted, may be new.
        empty = counts.sparkSession.range(1).select(F.lit(int(codes("")[0]) % SYMBOLS ** k).alias("code"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("taken"))
        asked = level.unionByName(empty).groupBy("code").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"))
        asked = asked.withColumn("context", context).join(contexts, "context", "left")
        if out is None:
            lower = asked.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            lower = asked.withColumn("suffix", F.col("code") % SYMBOLS ** (k - 1)).join(out.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
        own = F.coalesce((F.col("n") - F.col("taken")) / F.col("total"), F.lit(0.0))
        out = lower.select("code", "n", (own + F.coalesce(F.col("left") / F.col("total"), F.lit(1.0)) * F.col("lower")).alias("p"))
    return out


class KneserNey:
    """The model of `probabilities` in memory, for few n-grams, and of unseen ones too.

    Each order has its n-gram codes and their probabilities, and the codes of contexts with the weight that is left to the
    order below. The lowest order is interpolated with the uniform distribution.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code)
        code, n = code[order].astype(np.int64), n[order].astype(np.float64)
        levels = []
        for k in range(ORDER, 0, -1):
            levels.append((k, code, n))
            # Continuation counts: different symbols before an n-gram of the order below.
            code, n = np.unique(code % SYMBOLS ** (k - 1), return_counts=True)
            n = n.astype(np.float64)
        self.uniform = 1.0 / SYMBOLS
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, code, n in reversed(levels):
            discount = np.r_[0, _discounts(*(float((n == c).sum()) for c in (1, 2, 3, 4)))]
            taken = discount[np.minimum(n, 3).astype(int)]
            context, first = np.unique(code // SYMBOLS, return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            weight = (np.add.reduceat(taken, first) if len(n) else n) / np.maximum(total, 1)
            place = np.searchsorted(context, code // SYMBOLS)
            own = (n - taken) / total[place] + weight[place] * self._probability(code % SYMBOLS ** (k - 1))
            self.levels.append((k, code, own, context, weight))

    def _probability(self, code: np.ndarray) -> np.ndarray:
        """By the orders built so far; the code has the highest of them."""
        p = np.full(len(code), self.uniform)
        for k, known, own, context, weight in self.levels:
            if not len(known):
                continue
            asked = code % SYMBOLS ** k
            before = asked // SYMBOLS
            at = np.minimum(np.searchsorted(context, before), len(context) - 1)
            p = np.where(context[at] == before, weight[at], 1.0) * p
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            p = np.where(known[at] == asked, own[at], p)
        return p

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[-1][1], np.log(self.levels[-1][2])

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """Natural logarithms; n-grams of the highest order are looked up, the others back off."""
        known, own = self.sorted
        if not len(known):
            return np.full(len(code), np.log(self.uniform))
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        out, new = own[at].astype(np.float64), known[at] != code
        if new.any():
            out[new] = np.log(self._probability(code[new].astype(np.int64)))
        return out

    @property
    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_sorted"):
            self._sorted = self.table()
        return self._sorted


def learn(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(code, n, log) of all n-grams of all texts; log probabilities in STEPS of a nat."""
    found = probabilities(texts.checkpointed(count(docs, text_column)))
    return texts.checkpointed(found.select("code", "n", F.round(F.log("p") * STEPS).cast("long").alias("log")))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.zeros(len(words), bool)
    at = np.flatnonzero([often[w] > 1 for w in windows])
    for shift in range(3):
        hit[at + shift] = True
    return int(hit.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(texts.SPACES)] if b"\n" in data else []
    return (len(words), len(text) - (len(data) - len(data.translate(None, texts.SPACES))), len(data) - len(data.translate(None, SIGNS.encode())),
            len(lines) - len(set(lines)), repeated_words(words))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def assess(docs: DataFrame, model: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, lang, measures, log_perplexity, n_units) of each whole text; null texts count as empty, null languages as one of their own.

    The model is that of the same texts, or of more. log_perplexity is the mean negative log probability of a unit, in nats.
    """
    total = model.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * FREQUENT > total
    often = model.filter(frequent).select("code", "log").toPandas()  # fewer than FREQUENT
    often = often.sort_values("code")
    sent = docs.sparkSession.sparkContext.broadcast((often["code"].to_numpy(np.int64), often["log"].to_numpy(np.int64)))
    names = ["id", "lang", "row", *[m.split()[0] for m in MEASURES.split(", ")], "logs", "n_units", "codes", "times"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = sent.value

        def judged(text: str | None) -> tuple:
            found, times = np.unique(codes(text), return_counts=True)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            hit = known[at] == found if len(known) else np.zeros(len(found), bool)
            return *measures(text), int(times[hit] @ logs[at[hit]]), int(times.sum()), found[~hit], times[~hit]

        for batch in rows:
            if batch.num_rows:
                *found, rest, times = zip(*map(judged, batch.column(3).to_pylist()))
                offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in rest])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (rest, times)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, found), *lists], names)

    scored = texts.checkpointed(docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.monotonically_increasing_id().alias("row"),
        F.col(text_column).alias("text")).mapInArrow(
        batches, f"id {texts.kind(docs, id_column)}, lang string, row long, {MEASURES}, logs long, n_units long, codes array<long>, times array<long>"))
    rest = scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("r")).select("row", F.col("r.codes").alias("code"), F.col("r.times").alias("times"))
    more = rest.join(model.filter(~frequent), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0))
    return scored.drop("codes", "times").join(more, "row", "left").withColumn("log_perplexity", -logs / (F.col("n_units") * STEPS)).select(
        "id", "lang", *names[3:8], "log_perplexity", "n_units")


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))


def medians(values: DataFrame, column: str, steps: int) -> DataFrame:
    """(lang, median of the column), to within half a step of 1 / steps.

    Rounded values are counted ahead of the shuffle, so that a language sends one row per step that occurs.
    """
    counts = values.select("lang", F.round(F.col(column) * steps).cast("long").alias("v")).groupBy("lang", "v").count()
    so_far = F.sum("count").over(Window.partitionBy("lang").orderBy("v"))
    whole = F.sum("count").over(Window.partitionBy("lang"))
    ranked = counts.select("lang", "v", so_far.alias("so_far"), whole.alias("whole"))
    return ranked.filter("2 * so_far >= whole").groupBy("lang").agg((F.min("v") / steps).alias(column))


def bands(assessed: DataFrame) -> DataFrame:
    """(lang, middle, own, between) from the documents of a language that pass the base rules.

    `middle` is the median log perplexity, `own` the deviation of one character, `between` that of documents of at least
    the median length, never less than LEAST_SPREAD.
    """
    sound = assessed.filter(~base_failed()).select("lang", "log_perplexity", F.log2("n_units").alias("length"))
    middle = session.written(medians(sound, "log_perplexity", 1000).join(medians(sound, "length", 100), "lang")
                             .toDF("lang", "middle", "half"), "llm_band_middles")
    off = sound.join(middle, "lang").withColumn("off", F.abs(F.col("log_perplexity") - F.col("middle")))
    own = medians(off.select("lang", (F.col("off") * F.pow(F.lit(2.0), F.col("length") / 2)).alias("own")), "own", 100)
    between = medians(off.filter("length >= half - 0.005").select("lang", F.col("off").alias("between")), "between", 2000)
    return middle.join(own, "lang").join(between, "lang").select(
        "lang", "middle", (_NORMAL * F.col("own")).alias("own"), F.greatest(_NORMAL * F.col("between"), F.lit(LEAST_SPREAD)).alias("between"))


def deviation() -> F.Column:
    """Standard deviations between a document's log perplexity and its language's middle."""
    spread = F.sqrt(F.col("own") * F.col("own") / F.col("n_units") + F.col("between") * F.col("between"))
    return (F.col("log_perplexity") - F.col("middle")) / spread


def filtered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(id, lang, measures, log_perplexity, n_units, base_failed, kept) of every row, by a model and bands of all rows.

    kept: the base rules pass and the perplexity lies in its language's band. A language none of whose documents pass has
    no band, and needs none. Repeated rows each give a row; an empty table gives none.
    """
    assessed = texts.checkpointed(assess(docs, learn(docs, text_column), id_column, text_column, lang_column))
    limits = session.written(bands(assessed), "llm_bands")
    judged = assessed.join(limits, "lang", "left").withColumn("base_failed", base_failed())
    inside = F.coalesce(F.abs(deviation()) <= BAND_WIDTH, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("middle", "own", "between")
