"""Exact ids of a byte-level pair tokenizer, by dynamic programming over the prefixes of each piece."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Splits a text into pieces that are encoded on their own: contractions, words, numbers, symbols, blanks. A fixed value
#: of the public vocabulary, with white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A worker forgets all pieces when it knows this many.
KNOWN = 300_000
#: Pieces longer than this many characters are not kept.
KEPT_CHARS = 64


def default_vocabulary() -> str:
    """The file of byte_bpe_50k: that of GRAPHRILL_TOKENIZER if set, else of the installed public vocabularies."""
    if path := os.environ.get("GRAPHRILL_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts by a vocabulary file (JSON) with its merges in order.

    A sequence of tokens is what merging gives if and only if each two neighbours are: so every prefix of a piece has one
    last token that is compatible with the last token of the prefix before it. An automaton finds all tokens that end at
    each byte; the longest that is compatible is kept; following the kept tokens back from the end gives the ids.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        self.size = max(ids.values()) + 1
        raw = {t: bytes(letters[c] for c in t).decode("latin-1") for t in ids if all(c in letters for c in t)}
        self.merged: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = ids[a + b]
            self.merged[ids[a], ids[b]] = rank
            if token not in self.halves:
                self.halves[token], self.order[token] = (ids[a], ids[b]), rank
        self.automaton = ahocorasick.Automaton()
        for t, text in raw.items():
            if len(text) == 1 or ids[t] in self.halves:
                self.automaton.add_word(text, (ids[t], len(text)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)

    def compatible(self, a: int, b: int) -> bool:
        """Would the tokens a and b stay apart when their bytes are merged together?

        The merges of both are undone along the border, the latest first, and no two tokens that meet there may merge
        before the one just undone. At equal order the left of two merges goes first.
        """
        order, halves, merged = self.order, self.halves, self.merged
        limit = (len(merged), 0)
        while True:
            meet = merged.get((a, b))
            if meet is not None and (meet, 1) < limit:
                return False
            x, y = order.get(a, -1), order.get(b, -1)
            if x < 0 and y < 0:
                return True
            # What meets at the border merges after a merge of equal rank in the left token, and before one in the right.
            if x > y:
                limit, a = (x, 1), halves[a][1]
            else:
                limit, b = (y, 2), halves[b][0]

    def learn(self, pieces) -> dict[str, bytes]:
        """The ids (as bytes of int32) of each piece."""
        pieces = list(pieces)
        coded = [p.encode("utf-8").decode("latin-1") for p in pieces]
        text = "Ā".join(coded) + "Ā"  # no token has this character
        last, size = [-1] * len(text), [0] * len(text)
        first = bytearray(len(text) + 1)
        at, ends = 0, []
        for c in coded:
            first[at] = 1
            at += len(c) + 1
            ends.append(at - 2)
        fits, size_of_all = self.fits, self.size
        for end, (token, length) in self.automaton.iter(text):
            if last[end] < 0:
                begin = end - length
                if first[begin + 1]:
                    last[end], size[end] = token, length
                elif (before := last[begin]) >= 0:
                    pair = before * size_of_all + token
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        fit = fits[pair] = self.compatible(before, token)
                    if fit:
                        last[end], size[end] = token, length
        found = {}
        for piece, c, end in zip(pieces, coded, ends):
            begin, ids = end - len(c), []
            while end > begin:
                ids.append(last[end])
                end -= size[end]
            found[piece] = np.array(ids[::-1], np.int32).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of int32; null and empty texts have none."""
        out = []
        known = self.known
        for text in texts:
            if not text:
                out.append(b"")
                continue
            pieces = self.pattern.findall(text)
            if new := set(pieces).difference(known):
                if len(known) > KNOWN:
                    known.clear()
                    new = set(pieces)
                learnt = self.learn(new)
                known.update(learnt)
                out.append(b"".join(map(known.__getitem__, pieces)))
                for p in new:
                    if len(p) > KEPT_CHARS:
                        del known[p]
            else:
                out.append(b"".join(map(known.__getitem__, pieces)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each text by the vocabulary at ``path``, which every executor must have.

    Null and empty texts have the empty list; blank texts are encoded as they are; whole texts are encoded, whatever their
    length. One row for each row of ``docs``, without a shuffle.
    """
    path = path or default_vocabulary()
    kept = docs.select(doc_id, text)

    def run(batches):
        e = encoder(path)
        for batch in batches:
            parts = e.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(parts), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[doc_id, "ids"])

    return kept.mapInArrow(run, f"`{doc_id}` {kept.schema[doc_id].dataType.simpleString()}, ids array<int>")


__all__ = ["Encoder", "encode", "encoder"]
