import random

import numpy as np
import pytest
import xxhash

from corpora import docs, key, odd_texts, sentence
from hitlytics.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    found = {}
    for i, x in enumerate(ids):
        found.setdefault(root(i), []).append(x)
    return [min((y for y in found[root(i)] if y is not None), default=None) for i in range(len(ids))]


def test_fingerprints_of_odd_texts():
    for _, text in odd_texts():
        assert simhash.fingerprint(text) == brute_print(text)
    rng = random.Random(3)
    for _ in range(50):
        text = sentence(rng, rng.randrange(40))
        assert simhash.fingerprint(text) == brute_print(text)


def test_components_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = odd_texts()
    for n in range(60):
        base = sentence(rng, 200).split()
        for copy in range(rng.randrange(1, 4)):
            words = list(base)
            for _ in range(copy):
                words[rng.randrange(len(words))] = "changed"
            texts.append((100 + 10 * n + copy, " ".join(words)))
    rng.shuffle(texts)
    found = simhash.near_duplicates(docs(spark, texts)).collect()
    prints = [brute_print(t) for _, t in texts]
    want = brute_components([i for i, _ in texts], prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert sorted(map(key, found)) == sorted(map(key, zip([i for i, _ in texts], signed, want)))


def test_table_equals_brute_force(spark, sf_dir):
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = [brute_print(table[i]) for i in found["id"]]
    assert [p % (1 << 64) for p in found["print"]] == prints
    assert brute_components(found["id"].tolist(), prints) == found["component"].tolist()


@pytest.mark.parametrize("limit", [4, 1024])
def test_links_keep_dense_groups_whole(spark, monkeypatch, limit):
    """Fingerprints around few centres: crowded groups are dealt on to the last level, and no link is lost."""
    monkeypatch.setattr(simhash, "GROUP_LIMIT", limit)
    rng = np.random.default_rng(2)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(80):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), False)))
    prints = sorted(prints)
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    want = brute_components(prints, prints)
    assert [roots.get(p, p) for p in prints] == want


def test_search_prunes_nothing_close():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 10, 500).astype(np.uint64)
    prints = np.unique(prints)
    left, right = simhash.links_within(prints, np.zeros(len(prints), np.int64))
    labels = {int(p): int(p) for p in prints}
    labels.update({int(a): int(b) for a, b in zip(left, right)})
    assert brute_components([int(p) for p in prints], [int(p) for p in prints]) == [labels[int(p)] for p in prints]


def test_long_chain_has_one_component(spark):
    links = [(n, n + 1) for n in range(300)]
    rng = random.Random(1)
    rng.shuffle(links)
    found = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.root for r in found} == {0} and {r.node for r in found} == set(range(1, 301))


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
