"""SentencePiece BPE in numpy: merge rounds over the symbols of many words at once.

Words are cut before each run of spaces, which no piece of such a model crosses, so each distinct
word of a batch is encoded once. Symbols of all distinct words lie in one flat array. A round finds
the best pair of every word, merges its leftmost occurrences in all words at the same time, and
compacts the array; rounds end when no word has a pair left.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import flat_bytes, map_pieces, text_column

_SPACE = "▁"
_NO_PAIR = np.int64(1) << 40
_SLOT_BITS = 19


def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * salt & (1 << 64) - 1)
    return (keys.astype(np.uint64) * factor >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.normal = {names[i]: i for i in range(n) if not special[i]}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.normal):
            raise ValueError("a piece crosses the start of a word")
        scores = np.array([model.get_score(i) for i in range(n)])
        # Equal scores rank equal: the leftmost pair is then merged first.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.byte_id = np.full(256, model.unk_id(), np.int64)
        # What an id adds to a decoded text; a space mark becomes a space.
        self.text = [b""] * n
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:-1], 16)
                self.byte_id[value], self.text[i] = i, bytes([value])
            elif not special[i]:
                self.text[i] = name.replace(_SPACE, " ").encode()
        self.text[model.unk_id()] = " ⁇ ".encode()
        # Characters that are no piece get ids above the vocabulary, by their code point.
        self.beyond = n
        self.char_id = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in self.normal.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        self.char_id[ord(" ")] = self.char_id[ord(_SPACE)]
        pairs = {}
        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        # Hash tables of places in pair_keys; keys that find their slot taken go to the next table.
        self.levels, rest = [], np.arange(len(pairs))
        while len(rest):
            slots, salt = np.full(1 << _SLOT_BITS, -1), len(self.levels)
            at = _slot(self.pair_keys[rest], salt)
            slots[at] = rest
            rest = rest[slots[at] != rest]
            self.levels.append((salt, slots))
        self.text_length = np.array([len(t) for t in self.text], np.int64)
        self.text_start = np.concatenate([[0], np.cumsum(self.text_length)])[:-1]
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)

    def _symbol(self, text: str) -> int | None:
        if len(text) == 1:
            return int(self.char_id[ord(text)])
        return self.normal.get(text)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that a pair of symbols makes, -1 if none."""
        keys = left << 32 | right
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for salt, slots in self.levels:
            at = slots[_slot(keys, salt)]
            hit = self.pair_keys[at] == keys
            out[todo[hit]] = self.pair_ids[at[hit]]
            more = ~hit & (at >= 0)
            todo, keys = todo[more], keys[more]
        return out

    def ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank[piece], _NO_PAIR)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word starts (and the last ends).

        A word is a text whose spaces all stand at its start.
        """
        n_chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data, _ = flat_bytes(words)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        symbols = self.char_id[points]
        owner = np.repeat(np.arange(len(words)), n_chars)
        done_symbols, done_owner = [], []
        pair = self._pairs(symbols, owner)
        while len(symbols):
            rank = self.ranks(pair)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[first, len(owner)])
            best = np.minimum.reduceat(rank, first)
            active = best < _NO_PAIR
            if not active.all():
                stays = np.repeat(active, lengths)
                done_symbols.append(symbols[~stays])
                done_owner.append(owner[~stays])
                symbols, owner, pair, rank = symbols[stays], owner[stays], pair[stays], rank[stays]
                lengths, best = lengths[active], best[active]
                if not len(symbols):
                    break
            chosen = self._chosen(symbols, owner, pair, rank, np.repeat(best, lengths))
            symbols = symbols.copy()
            symbols[chosen] = pair[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            # Only pairs beside a merged symbol have changed.
            new = np.cumsum(keep)[chosen] - 1
            beside = np.zeros(len(symbols), bool)
            beside[new] = beside[np.maximum(new - 1, 0)] = True
            touched = np.flatnonzero(beside)
            pair[touched] = self._pairs(symbols, owner, touched)
        symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return self._ids(symbols[order], owner[order], len(words))

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None):
        """The piece made by each symbol and its right neighbour in the same word, -1 if none."""
        at = np.arange(len(symbols)) if at is None else at
        if not len(symbols):
            return at
        after = np.minimum(at + 1, len(symbols) - 1)
        inside = (after > at) & (owner[after] == owner[at])
        return np.where(inside, self.merged(symbols[at], symbols[after]), -1)

    def _chosen(self, symbols, owner, pair, rank, best) -> np.ndarray:
        """Where to merge now: in each word the leftmost best pairs, as one by one would be merged.

        Best pairs that overlap are taken in turn from the left. A merge may make a pair
        that is better than the one merged; it would come next, so that merge is the last of
        its word in this round.
        """
        found = np.flatnonzero(rank == best)
        run = np.r_[True, found[1:] != found[:-1] + 1]
        place = np.arange(len(found)) - np.maximum.accumulate(np.where(run, np.arange(len(found)), 0))
        chosen = found[place % 2 == 0]
        merged = pair[chosen]
        taken = np.zeros(len(symbols), bool)
        taken[chosen] = True
        left, right = chosen - 1, chosen + 2
        has_left = (left >= 0) & (owner[np.maximum(left, 0)] == owner[chosen])
        has_right = (right < len(symbols)) & (owner[np.minimum(right, len(symbols) - 1)] == owner[chosen])
        two_left = np.maximum(chosen - 2, 0)
        joined = (chosen >= 2) & taken[two_left] & (owner[two_left] == owner[chosen])
        left_symbol = np.where(joined, pair[two_left], symbols[np.maximum(left, 0)])
        right_symbol = symbols[np.minimum(right, len(symbols) - 1)]
        rank_left = np.where(has_left, self.ranks(self.merged(left_symbol, merged)), _NO_PAIR)
        rank_right = np.where(has_right, self.ranks(self.merged(merged, right_symbol)), _NO_PAIR)
        stops = np.minimum(rank_left, rank_right) <= rank[chosen]
        word = owner[chosen]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        earlier = np.cumsum(stops) - stops
        earlier -= np.repeat(earlier[first], np.diff(np.r_[first, len(word)]))
        return chosen[earlier == 0]

    def _ids(self, symbols, owner, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the ids of their bytes."""
        odd = np.flatnonzero(symbols >= self.beyond)
        if len(odd):
            texts = [chr(int(c) - self.beyond).encode() for c in symbols[odd]]
            width = np.ones(len(symbols), np.int64)
            width[odd] = [len(t) for t in texts]
            at = np.cumsum(width) - width
            symbols, owner = np.repeat(symbols, width), np.repeat(owner, width)
            spread = np.concatenate([np.arange(len(t)) + at[i] for i, t in zip(odd, texts)])
            symbols[spread] = self.byte_id[np.frombuffer(b"".join(texts), np.uint8)]
        return symbols, np.searchsorted(owner, np.arange(n_words + 1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, with begin and end, and where each text starts."""
        spaced = pc.replace_substring(texts, _SPACE, " ")
        spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, pc.binary_join_element_wise(" ", spaced, ""))
        data, offsets = flat_bytes(spaced)
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        n_words = np.diff(np.searchsorted(starts, offsets))
        bounds = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
        distinct = words.dictionary_encode()
        ids, at = self.encode_words(distinct.dictionary)
        word = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(at)[word]
        # Ids of every word in order of the texts, with a begin and an end around each text.
        text_of_word = np.repeat(np.arange(len(texts)), n_words)
        n_ids = np.bincount(text_of_word, lengths, len(texts)).astype(np.int64) + 2
        text_at = np.concatenate([[0], np.cumsum(n_ids)])
        out = np.empty(text_at[-1], np.int64)
        out[text_at[:-1]], out[text_at[1:] - 1] = self.begin, self.end
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(at[word] - (ends - lengths), lengths)
        target = np.arange(total) + np.repeat(2 * text_of_word + 1, lengths)
        out[target] = ids[source]
        return out, text_at

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each run of ids: pieces joined, the space put before the text taken off."""
        if ((ids < 0) | (ids >= self.beyond)).any():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.text_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.text_start[ids] - (ends - lengths), lengths)
        data = self.text_bytes[place].tobytes()
        at = np.concatenate([[0], ends])[starts]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [t.removeprefix(" ") for t in texts]


@functools.lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def _encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, PieceModel]:
    model = load_model(path)
    ids, at = model.encode(texts)
    return ids, at, model


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids (with begin and end).

    ``docs`` needs doc_id and text; other columns are ignored. A NULL text is an empty one, whose
    ids are begin and end. Rows with the same doc_id stay separate rows. ``path`` names the model
    file, which every executor must have.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            ids, at, _ = _encode(path, text_column(batch, "text"))
            lists = pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))
            return {"doc_id": batch.column(0), "ids": lists}

        return work

    return map_pieces(docs.select("doc_id", "text"), "text", "doc_id long, ids array<int>", make)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text. NULL ids give a NULL text."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decoded(lists):
        model = load_model(path)
        known = [np.asarray(x if x is not None else [], np.int64) for x in lists]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in known])]).astype(np.int64)
        texts = model.decode(np.concatenate(known) if known else np.zeros(0, np.int64), starts)
        return lists.__class__([None if x is None else t for x, t in zip(lists, texts)])

    return encoded.select("doc_id", decoded("ids").alias("text"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of the text decoded from them.

    The same ids and texts as ``encode_documents`` and ``decode_documents``, digested where
    they are made, so that neither is shipped. Rules for NULLs and repeated rows are the same.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            ids, at, model = _encode(path, text_column(batch, "text"))
            raw = ids.astype("<u4").tobytes()
            texts = model.decode(ids, at)
            return {
                "doc_id": batch.column(0),
                "n_tokens": np.diff(at),
                "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            }

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_pieces(docs.select("doc_id", "text"), "text", schema, make)
