"""Personal data: patterns against plain expressions, gradients, and the trained tagger."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tallyloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and check % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_patterns():
    rng = random.Random(3)
    parts = [*"ab1.@-+ ()9é😀\n", "1.2.3.4", "300.1.1.1", "a@b.c", "+1 (234) 555-1234", "4111 1111 1111 1111"]
    for _ in range(6_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.b" * 100_000 + "@", "1.2" * 100_000, "+" * 100_000):
        pii.base_spans(text)


def test_gradients():
    ids, tags = pii._labelled(pii._made_snippets(np.random.default_rng(0), 5))
    tagger = pii._new_tagger()

    def loss():
        _, mask, both, _, _ = tagger._states(ids)
        scores = tagger._emissions(both)
        _, _, total = tagger._forward(scores, mask)
        moves = tagger.p["moves"] + tagger.forbidden
        for r in range(len(ids)):
            n = int((ids[r] > 0).sum())
            y = tags[r, :n]
            total[r] -= tagger.p["first"][y[0]] + scores[np.arange(n), r, y].sum() + moves[y[:-1], y[1:]].sum()
        return total.mean()

    slopes = tagger._gradients(ids, tags)
    places = {"embed": (int(ids[0, 3]), 2), "moves": (0, 1), "out_bias": (1,), "first": (0,), "l_bias": (30,), "r_bias": (7,)}
    for name in tagger.p:
        at = places.get(name, (3, 2))
        tagger.p[name][at] += 1e-5
        up = loss()
        tagger.p[name][at] -= 2e-5
        down = loss()
        tagger.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-4


@pytest.fixture(scope="module")
def tagger():
    return pii.train_tagger(None)


def test_made_spans_are_found(tagger):
    made = pii._made_snippets(np.random.default_rng(5), 400)
    found = pii.Finder(tagger).spans([t for t, _ in made])
    hits = [any(s == g for g in every) for (_, spans), (_, every) in zip(made, found) for s in spans]
    wrong = [len(set(every) - set(spans) - set(own)) for (_, spans), (own, every) in zip(made, found)]
    assert np.mean(hits) > 0.85 and np.mean(wrong) < 0.08


def test_windows_cover_all_triggers():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 1@") if rng.random() < 0.1 else "x" for _ in range(n)) for n in (0, 5, 95, 96, 97, 3_000)]
    texts.append("7" * 5_000)
    ids, places = pii._windows(texts)
    for number, text in enumerate(texts):
        own = [(a, b) for t, a, b in places if t == number]
        for i, c in enumerate(text):
            if c in "1@7":
                assert any(a <= i < b for a, b in own)
                assert any((a == 0 or i - a >= 20) and (b == len(text) or b - i >= 20) for a, b in own)


def test_reconciled_spans_do_not_overlap():
    found = [(5.0, (0, 0, 8)), (6.0, (0, 4, 14)), (5.0, (0, 8, 16)), (9.0, (1, 20, 30))]
    assert pii._reconciled(found, [(3, 22, 25)]) == [(0, 0, 8), (0, 8, 16)]


SCHEMA = "doc_id long, text string, spans string, n_chars long"


def test_documents(spark, tagger):
    texts = [None, "", "mail me at a.b@c.org now", "call 4111111111111111 or 10.0.0.1", "x" * 200_000 + " 10.0.0.1"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "10.0.0.1", "x", 1), (2, texts[2], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pii.find_personal_data(df, tagger).collect()
    assert len(got) == len(rows)
    for row in got:
        text = dict((r[0], r[1]) for r in rows)[row["doc_id"]] or ""
        own = plain(text)
        assert row["base_sha256"] == hashlib.sha256(pii.spell(own).encode()).hexdigest()
        assert set(pii.spell(own).split(",")) - {""} <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in own) for i in range(4)]
    masked = pii.mask_personal_data(df, tagger)
    assert masked.columns == df.columns
    by_id = {r["doc_id"]: r for r in masked.collect()}
    assert by_id[2]["text"] == "mail me at <email> now" and by_id[2]["n_chars"] == 22
    assert by_id[0]["text"] is None and by_id[0]["n_chars"] is None
    assert by_id[4]["text"].endswith(" <ip>")
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA), tagger).collect() == []


def test_training_reads_the_documents(spark):
    rows = [(i, f"word {i} a{i}@b.example.org and so on") for i in range(30)]
    own = pii.corpus_snippets(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert len(own) == 10 and all(spans for _, spans in own)
