"""Personal data in texts: fixed patterns, and a character tagger that adds what they miss.

A bidirectional LSTM with CRF transitions is trained on labelled spans: those that the patterns find
in a sample of the documents, as they stand and rewritten in forms that the patterns don't cover.
It reads overlapping windows around every digit, @ sign, bracketed "at" and "dot" of a text, in any case.
Each window is decoded; where a span touches a window's edge, a wider window around it is decoded too.
Of all spans found in a text those that together weigh most are kept. A card must pass Luhn's test.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm import Tagger
from .common import map_pieces, pieces, text_column

KINDS = ("email", "ip", "card", "phone")
# Documents whose snippets the tagger learns from: those with the least hash of doc_id and text.
SNIPPET_DOCS = 2_000
ROUNDS = 320
WINDOW = 96
# A span that touches the edges of a window this wide is none.
WIDEST = 8 * WINDOW
# Least mean probability of the tags of an added span.
SURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A look behind saves a run of digits from being tried again from each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({<] ?[aA][tT] ?[\])}>]|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z])")

_AT_FORM = re.compile(r" ?[\[({<] ?[aA][tT] ?[\])}>] ?| [aA][tT] | ?@ ?")
_DOT_FORM = re.compile(r" ?[\[({<] ?(?:[dD][oO][tT]|\.) ?[\])}>] ?| [dD][oO][tT] ")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@" + _DOMAIN.pattern)
# Ends of addresses that are taken for one without any mark.
_COMMON_ENDS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "eu", "de", "fr", "es", "it", "uk")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[Span]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if found:
            done = at = found.end()
            yield 0, start, done


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the fixed patterns, by start and then kind, in code points."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _char_id(c: str) -> int:
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return 1 + ord(c.lower()) - 97
    if "0" <= c <= "9":
        return 27
    if c == "\n":
        return 28
    if " " <= c <= "~":
        return 29 + _MARKS.index(c)
    return 29 + len(_MARKS)


_MARKS = "".join(c for c in map(chr, range(0x20, 0x7F)) if not c.isalnum())
_N_IDS = 30 + len(_MARKS)
_IDS = np.full(0x110000, 29 + len(_MARKS), np.int64)
_IDS[:0x80] = [_char_id(chr(c)) for c in range(0x80)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32)


def _new_tagger(seed: int = 0) -> Tagger:
    """Tag 0 stands outside spans; 1 + 2k begins a span of kind k and 2 + 2k goes on with it."""
    n = 1 + 2 * len(KINDS)
    allowed, starts = np.ones((n, n), bool), np.ones(n, bool)
    for tag in range(2, n, 2):
        allowed[:, tag] = False
        allowed[[tag - 1, tag], tag] = True
        starts[tag] = False
    return Tagger(_N_IDS, n, allowed, starts, seed=seed)


def _rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """A form of a span that the patterns do not cover."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == 0:
        local, _, domain = text.partition("@")
        mark = [" [at] ", " (at) ", "[at]", "(at)", " @ ", " [At] ", " {AT} ", " at "][rng.integers(8)]
        dot = [" [dot] ", ".", "(dot)", ".", " dot ", " [DOT] "][rng.integers(6)]
        if mark == " at ":
            # Nothing but the dots tells such an address from prose.
            dot = [" dot ", " DOT "][rng.integers(2)]
            local = local.replace(".", dot)
        return local + mark + domain.replace(".", dot)
    if kind == 1:
        return text.replace(".", ["[.]", "(.)"][rng.integers(2)])
    if kind == 2:
        cut = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".", "/", "_", " - "][rng.integers(4)].join(cut)
    d = digits[-10:] if len(digits) >= 10 else digits
    forms = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}")
    return forms[rng.integers(4)]


def _made_snippets(rng: np.random.Generator, n: int) -> list[tuple[str, list[Span]]]:
    """Snippets of made words, spans and numbers that are no personal data."""

    def word() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def number(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def span(kind: int) -> str:
        if kind == 0:
            local = [f"{word()}.{number(2)}", word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{number(2)}"][rng.integers(5)]
            host = [f"{word()}{number(1)}", word(), f"{word()}.{word()}", f"{word()}-{word()}"][rng.integers(4)]
            return f"{local}@{host}.{['com', 'org', 'net', word()][rng.integers(4)]}"
        if kind == 1:
            return ".".join(str(v) for v in rng.integers(0, 256, 4))
        if kind == 2:
            digits = number(15)
            return next(digits + c for c in "0123456789" if _luhn(digits + c))
        return f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}"

    def other() -> str:
        forms = (f"version {number(1)}.{number(1)}", f"in {1900 + rng.integers(0, 130)}", f"{number(2)}.{number(2)}.{1950 + rng.integers(0, 80)}",
                 f"{number(rng.integers(1, 9))}", f"AKIA{number(4)}{word().upper()}{number(3)}", f'token = "{hashlib.sha1(word().encode()).hexdigest()}"',
                 f"{number(3)},{number(3)}", f"@{word()}", f"{number(1)}.{number(2)}%", f"${number(3)}.{number(2)}", f"{number(2)}:{number(2)}", f"{number(20)}")
        return forms[rng.integers(len(forms))]

    out = []
    for _ in range(n):
        before = " ".join(word() for _ in range(rng.integers(1, 8)))
        after = " ".join(word() for _ in range(rng.integers(1, 8)))
        if rng.random() < 0.4:
            out.append((f"{before} {other()} {after}", []))
            continue
        kind = int(rng.integers(4))
        text = span(kind)
        if rng.random() < 0.5:
            text = _rewritten(kind, text, rng)
        start = len(before) + 1
        out.append((f"{before} {text} {after}", [(kind, start, start + len(text))]))
    return out


def _windows(texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Windows over the parts of texts near a trigger: ids, and (text, first, last place)."""
    rows, places = [], []
    for number, text in enumerate(texts):
        points, end = None, 0
        for m in _TRIGGER.finditer(text):
            if m.start() < end - WINDOW // 2:
                continue
            # A window is laid at the trigger; the next begins half a window on while triggers go on.
            start = max(0, m.start() - WINDOW // 2)
            if end and start < end:
                start = end - WINDOW // 2
            end = min(len(text), start + WINDOW)
            points = _points(text) if points is None else points
            ids = np.zeros(WINDOW, np.int64)
            ids[: end - start] = _IDS[points[start:end]]
            rows.append(ids)
            places.append((number, start, end))
            end = start + WINDOW
    return np.array(rows).reshape(len(rows), WINDOW), places


def _labelled(snippets: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((len(snippets), WINDOW), np.int64), np.zeros((len(snippets), WINDOW), np.int64)
    for row, (text, spans) in enumerate(snippets):
        points = _points(text)[:WINDOW]
        ids[row, : len(points)] = _IDS[points]
        for kind, start, end in spans:
            if end <= WINDOW:
                tags[row, start] = 1 + 2 * kind
                tags[row, start + 1 : end] = 2 + 2 * kind
    return ids, tags


def corpus_snippets(docs: DataFrame, rows: int = SNIPPET_DOCS) -> list[tuple[str, list[Span]]]:
    """Snippets around triggers, with their labelled spans, of at most ``rows`` documents.

    They are the documents with the least hash of doc_id and text among those with a digit or an @.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            keys, snippets = [], []
            texts = text_column(batch, "text").to_pylist()
            for key, text in zip(batch.column(1).to_pylist(), texts):
                _, places = _windows([text])
                step = max(1, len(places) // 4)
                for _, start, end in places[::step][:4]:
                    keys.append(key)
                    snippets.append(text[start:end])
            return {"key": keys, "snippet": snippets}

        return work

    key = F.xxhash64("doc_id", "text", F.lit(3))
    marked = docs.filter(F.col("text").rlike("[0-9@]")).select("text", key.alias("key"))
    # Keys are ranked without their texts; rows with equal keys are equal rows.
    last = marked.select("key").orderBy("key").limit(rows).agg(F.max("key")).first()[0]
    if last is None:
        return []
    chosen = marked.filter(F.col("key") <= last).limit(rows)
    found = map_pieces(chosen, "text", "key long, snippet string", make).distinct().collect()
    return [(s, base_spans(s)) for _, s in sorted((r["key"], r["snippet"]) for r in found)]


def train_tagger(docs: DataFrame | None, rounds: int = ROUNDS) -> Tagger:
    """Train on labelled snippets of the documents, rewritten forms of them, and made snippets."""
    rng = np.random.default_rng(11)
    own = corpus_snippets(docs) if docs is not None else []
    changed = []
    for text, spans in own:
        whole = [s for s in spans if s[1] > 0 and s[2] < len(text)]
        if len(whole) == 1 and len(spans) == 1:
            kind, start, end = whole[0]
            new = _rewritten(kind, text[start:end], rng)
            changed.append((text[:start] + new + text[end:], [(kind, start, start + len(new))]))
    tagger = _new_tagger()
    tagger.train(*_labelled([*own, *changed, *_made_snippets(rng, 3_000)]), rounds)
    return tagger


def _reconciled(found: list[tuple[float, Span]], taken: list[Span]) -> list[Span]:
    """Spans that overlap neither each other nor ``taken`` and together weigh most."""
    found = [f for f in found if not any(f[1][1] < e and s < f[1][2] for _, s, e in taken)]
    found.sort(key=lambda f: (f[1][2], f[1][1], f[1][0]))
    best: list[tuple[float, list]] = [(0.0, [])]
    ends = [f[1][2] for f in found]
    for i, (weight, span) in enumerate(found):
        earlier = int(np.searchsorted(ends[:i], span[1], side="right"))
        joined = best[earlier][0] + weight
        best.append((joined, [*best[earlier][1], span]) if joined > best[-1][0] + 1e-9 else best[-1])
    return best[-1][1]


def _is_address(found: str) -> bool:
    """True if a rewritten address, written back, is one; in bare words it must end as most do."""
    plain = _DOT_FORM.sub(".", _AT_FORM.sub("@", found))
    if not _ADDRESS.fullmatch(plain):
        return False
    marked = "@" in found or any(c in "[]({<" for c in found)
    return marked or plain.rsplit(".", 1)[1].lower() in _COMMON_ENDS


def _possible(kind: int, text: str, span: Span) -> bool:
    """False for what no card, phone or address can be, however it is written."""
    found = text[span[1] : span[2]]
    if KINDS[kind] == "email":
        return _is_address(found)
    digits = "".join(c for c in found if c in "0123456789")
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if KINDS[kind] == "phone":
        return 9 <= len(digits) <= 15
    if KINDS[kind] == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return True


def _around(text: str, span: Span, width: int) -> tuple[int, int]:
    """A window of a width with a span in its middle."""
    start = max(0, min((span[1] + span[2] - width) // 2, len(text) - width))
    return start, min(len(text), start + width)


class Finder:
    """Finds all spans of texts with a trained tagger."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def _decoded(self, texts: list[str], ids: np.ndarray, places: list, out: list[list]) -> list[tuple[int, Span]]:
        """Adds the weighted spans of windows to ``out``; returns those that an edge cuts."""
        cuts = []
        for first in range(0, len(ids), 512):
            tags, shares = self.tagger.decode(ids[first : first + 512])
            for row, (number, start, end) in enumerate(places[first : first + 512]):
                size = end - start
                for at in np.flatnonzero(tags[row, :size] % 2 == 1):
                    kind, stop = int(tags[row, at]) // 2, int(at) + 1
                    while stop < size and tags[row, stop] == tags[row, at] + 1:
                        stop += 1
                    cut = at == 0 and start > 0 or stop == size and end < len(texts[number])
                    sure = shares[row, at:stop].mean()
                    span = (kind, int(start + at), int(start + stop))
                    if cut and sure >= SURE:
                        cuts.append((number, span))
                    elif sure >= SURE and stop - at >= 7 and _possible(kind, texts[number], span):
                        out[number].append((float(sure * (stop - at)), span))
        return cuts

    def tagged(self, texts: list[str]) -> list[list[tuple[float, Span]]]:
        """Weighted spans of all windows of each text, with wider windows around spans that edges cut."""
        out: list[list] = [[] for _ in texts]
        ids, places = _windows(texts)
        cuts, width = self._decoded(texts, ids, places, out), 2 * WINDOW
        while cuts and width <= WIDEST:
            places = sorted({(number, *_around(texts[number], span, width)) for number, span in cuts})
            ids = np.zeros((len(places), width), np.int64)
            for row, (number, start, end) in zip(ids, places):
                row[: end - start] = _IDS[_points(texts[number][start:end])]
            cuts, width = self._decoded(texts, ids, places, out), 2 * width
        return out

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Of each text its base spans, and these with the added ones."""
        base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
        out = []
        for own, found in zip(base, self.tagged(texts)):
            added = _reconciled(sorted(set(found), key=lambda f: f[1]), own) if found else []
            out.append((own, sorted([*own, *added], key=lambda s: (s[1], s[0]))))
        return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``docs`` needs doc_id and text; other columns are ignored. Counts and the digest are those of the
    base spans, ``spans`` has all. A NULL text is an empty one. Rows with the same doc_id stay
    separate rows. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train_tagger(docs))

    def make():
        finder = Finder(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            found = finder.spans(text_column(batch, "text").to_pylist())
            columns = {f"n_{k}": [sum(s[0] == i for s in own) for own, _ in found] for i, k in enumerate(KINDS)}
            digests = [hashlib.sha256(spell(own).encode()).hexdigest() for own, _ in found]
            return {"doc_id": batch.column(0), "base_sha256": digests, "spans": [spell(s) for _, s in found]} | columns

        return work

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_pieces(docs, "text", schema, make)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with all its columns, personal data in text masked.

    n_chars, if there, is the length of the new text. A NULL text stays NULL.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train_tagger(docs))
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in pieces(batches, "text"):
            texts = batch.column(at).to_pylist()
            found = finder.spans([t or "" for t in texts])
            texts = [None if t is None else mask(t, s) for t, (_, s) in zip(texts, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                lengths = [None if t is None else len(t) for t in texts]
                columns[counted] = pa.array(lengths, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
