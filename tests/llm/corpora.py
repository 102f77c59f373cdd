"""Small corpora with every odd case: null ids and texts, empty and long texts, repeats, clashing column names."""

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, id string, print long, row string, word string, "
        "held_out string, spans string, samples string, hash string, url string, type string")
WORDS = "the of and to in that is haan reoush hewh onon ing tion ndou anti thin stnd ndeha orth sthewh idiot über çedille 日本".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts(seed=1):
    rng = random.Random(seed)
    plain = sentence(rng, 60)
    return [
        (1, plain), (2, plain), (3, plain + " more"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"),
        (9, "x" * 5000), (10, sentence(rng, 20_000)), (None, plain), (None, None), (11, "A.B\nA.B\n\nç▁é 𝔘 end"),
        (11, "A.B\nA.B\n\nç▁é 𝔘 end"), (12, "... !!! ***"), (13, "\u00a0\u2003\u0000"), (14, sentence(rng, 300)),
    ]


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang if i is None or i % 2 else None, "s", None if t is None else len(t), "i", 5, "r", "w", "h", "s", "s", "h", "u", "t")
            for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def key(value):
    return tuple((x is None, x) for x in value)
