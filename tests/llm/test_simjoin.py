"""The similarity join against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest

from tallyloom.llm import simjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def grams(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string")
    return sorted((tuple(r) for r in simjoin.jaccard_components(df.repartition(parts)).collect()), key=repr)


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed, families=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(size):
            words = edit(rng, base, rng.randrange(5))
            if rng.random() < 0.3:
                words = words + passage
            text = " ".join(words)
            rows.append(text.upper() if rng.random() < 0.1 else text)
    rows += ["All rights reserved " * 3] * 5 + ["", " ", "one", "One", "one two", "a b c d e"]
    rng.shuffle(rows)
    return [(i * 7 - 100, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_small_tiles_and_few_hot_grams_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "TILE", 8)
    monkeypatch.setattr(simjoin, "FRAGMENT", 16)
    monkeypatch.setattr(simjoin, "HOT_GRAMS", 3)
    monkeypatch.setattr(simjoin, "_FLUSH", 200)
    rows = corpus(3, families=5, size=30)
    assert run(spark, rows) == brute(rows)


def test_a_chain_of_edits_is_one_component(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((1_000 - i, " ".join(words)))
        words = words[:]
        words[(i * 5) % 200] = f"new{i}"
    got = run(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {961}


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (3, "A b c d e f g"), (3, None), (4, None), (5, "x " * 40_000), (5, "x " * 40_000)]
    rows += [(None, "no partner and no id here"), (9, "Été a b c d e"), (8, "été a b c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
