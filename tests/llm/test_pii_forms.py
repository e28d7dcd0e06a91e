"""Rewritten personal data in the middle of long texts, and what is none."""

from __future__ import annotations

import numpy as np
import pytest

from tallyloom.llm import pii

FILLER = "the committee met again and the report was read in full by everyone present " * 8
LONG = "first.middle.lastname [at] department-of-things [dot] university-of-somewhere [dot] example [dot] org"


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(pii.train_tagger(None))


def found(finder, text):
    whole = f"{FILLER}{text} {FILLER}"
    return [(pii.KINDS[k], whole[a:b]) for k, a, b in finder.spans([whole])[0][1]]


@pytest.mark.parametrize(
    "kind, text",
    [
        ("phone", "(415) 555-0134"),
        ("card", "4111.1111.1111.1111"),
        ("ip", "10[.]0[.]0[.]7"),
        ("email", "jane.doe [at] example [dot] org"),
        ("email", "jane.doe [At] example.org"),
        ("email", "jane dot doe at example dot org"),
        ("email", LONG),
    ],
)
def test_forms_that_the_patterns_miss(finder, kind, text):
    assert pii.base_spans(text) == []
    assert found(finder, text) == [(kind, text)]


@pytest.mark.parametrize(
    "text",
    ["4111111111111112", "1234 5678 9012 3456", "we met at the dot on the map", "look at example.org for 3 of them", "dots at noon"],
)
def test_what_is_none(finder, text):
    assert found(finder, text) == []


def test_added_numbers_pass_the_rules():
    assert not pii._possible(2, "4111.1111.1111.1112", (2, 0, 19)) and pii._possible(2, "4111.1111.1111.1111", (2, 0, 19))
    assert not pii._possible(1, "10[.]0[.]0[.]700", (1, 0, 16)) and pii._possible(1, "10[.]0[.]0[.]70", (1, 0, 15))
    assert not pii._possible(3, "1234 5678 9012 3456", (3, 0, 19))


def test_held_out_snippets(finder):
    snippets = pii._made_snippets(np.random.default_rng(99), 500)
    hits = of = wrong = 0
    for text, spans in snippets:
        got = {(k, a - len(FILLER), b - len(FILLER)) for k, a, b in finder.spans([FILLER + text + " " + FILLER])[0][1]}
        of += bool(spans)
        hits += bool(spans) and spans[0] in got
        wrong += not spans and bool(got)
    assert hits >= 0.9 * of and wrong <= 5
