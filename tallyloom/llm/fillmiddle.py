"""Fill-in-the-middle: texts cut in three at unit boundaries and put in another order.

Cuts are drawn from a hash of the document's id, as numbers of units. A wavelet matrix over
the character classes of all texts of a piece turns these into places: ranks of the classes that
end a unit add up to boundary counts, and bisection on those counts finds both cuts of all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, map_pieces, text_column
from .wavelet import CONTINUED, UNITS, WaveletMatrix, classes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """The first four groups of 8 hex digits of the hash of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


class Cutter:
    """Cuts of the texts of one piece, all at once."""

    def __init__(self, texts: pa.Array, unit: str = "line"):
        data, self.offsets = flat_bytes(texts)
        self.data, self.ending = data, UNITS[unit]
        self.starts, self.ends = self.offsets[:-1], self.offsets[1:]
        self.matrix = WaveletMatrix(classes(data, self.offsets))
        self.before = self.matrix.rank_any(self.ending, self.starts)

    def n_units(self) -> np.ndarray:
        """Units of each text: those that end, and one more if something follows the last end."""
        ended = self.matrix.rank_any(self.ending, self.ends) - self.before
        some = self.ends > self.starts
        last = np.where(some, self.ends - 1, self.starts)
        closed = self.matrix.rank_any(self.ending, self.ends) > self.matrix.rank_any(self.ending, last)
        return ended + (some & ~closed)

    def places(self, units: np.ndarray) -> np.ndarray:
        """The place behind the first ``units`` units of each text, as an offset in the piece."""
        return self.matrix.select_any(self.ending, self.before + units, self.starts, self.ends)

    def n_chars(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Code points between places: bytes less those inside a character."""
        inside = self.matrix.rank(CONTINUED, last) - self.matrix.rank(CONTINUED, first)
        return last - first - inside


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The three parts in the order of a form, each behind its mark."""
    p, s, m = _MARKS
    if form == "psm":
        return p + prefix + s + suffix + m + middle
    return s + suffix + p + prefix + m + middle


def restore(form: str, output: bytes) -> bytes:
    """The text that ``output`` was made from; no part holds a mark, so each mark is found."""
    if form == "plain":
        return output
    first, second = (_MARKS[0], _MARKS[1]) if form == "psm" else (_MARKS[1], _MARKS[0])
    head, middle = output[len(first) :].split(_MARKS[2], 1)
    one, two = head.split(second, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transform(
    texts: pa.Array,
    doc_ids: list[int | None],
    unit: str,
    percent: int,
    spm_percent: int,
    seed: int,
) -> dict[str, list]:
    """Form, cuts and output of each text, in columns."""
    cutter = Cutter(texts, unit)
    n = cutter.n_units()
    drawn = np.array([draws(doc_id, seed) for doc_id in doc_ids], np.int64).reshape(-1, 4)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    cuts = [cutter.places(np.minimum(one, two)), cutter.places(np.maximum(one, two))]
    prefix_chars = cutter.n_chars(cutter.starts, cuts[0])
    middle_chars = cutter.n_chars(cuts[0], cuts[1])
    out = {name: [] for name in ("form", "prefix_chars", "middle_chars", "output")}
    # A piece holds little text, but a single text in it may be long: take it from the flat bytes.
    whole = cutter.data.data
    for i, (start, end) in enumerate(zip(cutter.starts, cutter.ends)):
        text = bytes(whole[start:end])
        if not text or drawn[i, 2] % 100 >= percent or any(mark in text for mark in _MARKS):
            row = ("plain", None, None, text)
        else:
            form = "spm" if drawn[i, 3] % 100 < spm_percent else "psm"
            a, b = int(cuts[0][i] - start), int(cuts[1][i] - start)
            output = arrange(form, text[:a], text[a:b], text[b:])
            row = (form, int(prefix_chars[i]), int(middle_chars[i]), output)
        for column, value in zip(out.values(), row):
            column.append(value)
    return {"n": n.tolist()} | out


def _mapped(
    docs: DataFrame, schema: str, finish: Callable[[dict], dict], unit, percent, spm_percent, seed
) -> DataFrame:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            doc_ids = batch.column(batch.schema.names.index("doc_id")).to_pylist()
            found = transform(text_column(batch, "text"), doc_ids, unit, percent, spm_percent, seed)
            return finish({"doc_id": doc_ids} | found)

        return work

    return map_pieces(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, make)


def fill_middle(
    docs: DataFrame, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7
) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars and output.

    ``docs`` needs doc_id and text; other columns are ignored. A text has ``n`` units (``line``,
    ``word`` or ``sentence``). A line ends behind its line feed, a word behind the blanks that follow it,
    a sentence at a stop before a blank or behind a line feed; both cuts are unit boundaries or the
    text's ends. Form ``plain`` leaves a text as it is: those that are empty or
    hold a mark, and all but ``percent`` in a hundred; ``spm_percent`` in a hundred of the others
    put the suffix first. Draws depend on seed and doc_id alone, so rows with one doc_id share
    them; a NULL doc_id counts as empty, a NULL text is an empty one. An empty table gives an
    empty table. Texts of any length are cut whole; no rows meet, so nothing is shuffled.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def finish(found: dict) -> dict:
        return found | {"output": pa.array(found["output"], pa.binary()).cast(pa.string())}

    return _mapped(docs, schema, finish, unit, percent, spm_percent, seed)


def fill_middle_digests(
    docs: DataFrame, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7
) -> DataFrame:
    """``fill_middle`` with SHA-256 digests of each output and of the text rebuilt from it."""
    schema = (
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
        "output_sha256 string, restored_sha256 string"
    )

    def finish(found: dict) -> dict:
        outputs = found["output"]
        restored = (restore(form, output) for form, output in zip(found["form"], outputs))
        return found | {
            "output_sha256": [hashlib.sha256(output).hexdigest() for output in outputs],
            "restored_sha256": [hashlib.sha256(text).hexdigest() for text in restored],
        }

    return _mapped(docs, schema, finish, unit, percent, spm_percent, seed)
