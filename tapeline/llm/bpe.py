"""Byte-pair encoding with a tokenization automaton.

The automaton's states are the tokens (the last one read) and its arcs say which token may
follow. It starts with all arcs between the single bytes. Each merge ``u v -> t``, in rank
order, is one gadget:

* ``t`` gets a state with the outgoing arcs of ``v``,
* every state with an arc to ``u`` gets one to ``t``,
* the arc from ``u`` to ``v`` goes, since the merge would have joined them.

An arc path is then a canonical tokenization, and every text has exactly one. The arc matrix
has billions of cells, so a gadget stores only what it copies and cuts: ``t`` points to the row
and the column that it was copied from, and the cut is one table entry. ``arc`` reads a cell
through those pointers; the cells met are kept in a transition table.

Encoding walks a pre-split word once. For each prefix the table gives the only token that can
end it, after a token that can end the shorter prefix; the arc labels along the path are the
ids. Decoding emits the labels of the ids, joined by single spaces as the file (it names no
decoder) asks for. Words met before are looked up.

Defined results: NULL counts as the empty text, which has no token; special tokens written
out in a text become their ids, as in the public library. Each row gives one row, in place;
an empty table gives none; texts of any length are encoded whole, a word that fills one too; other columns are
ignored whatever their names. Texts with characters newer than Python's tables are split by the public library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from tapeline.llm.common import map_texts

# Fixed values of the vocabulary file: its split pattern and word end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
CACHE_WORDS = 300_000
CACHE_LENGTH = 200
CACHE_ARCS = 500_000


def default_path() -> str:
    """The public vocabulary file; another file of the same kind may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return letters


class Automaton:
    """Gadgets of all merges, the tables of token bytes, and the labels."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], path: str = ""):
        self.path, self.splitter = path, None
        size = max([*vocab.values(), *special.values()]) + 1
        self.labels = [""] * size
        for token, i in (vocab | special).items():
            self.labels[i] = token
        self.special = special
        self.row = [-1] * size
        self.column = [-1] * size
        self.born = [-1] * size
        self.cut: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.byte_of = byte_of = {c: b for b, c in enumerate(_byte_letters())}
        # One letter tree over all tokens: next node by byte, and the token that a node ends, inside a word or at its end.
        self.next: list[dict[int, int]] = [{}]
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        for token, i in vocab.items():
            if i not in special.values():
                ends = token.endswith(WORD_END)
                self._spell([byte_of[c] for c in (token.removesuffix(WORD_END) if ends else token)], i, ends)
        self.words: dict[str, bytes] = {}

    def _gadget(self, rank: int, u: int, v: int, t: int) -> None:
        self.row[t], self.column[t], self.born[t] = v, u, rank
        self.cut[u << 20 | v] = rank

    def arc(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        key = a << 20 | b
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._read(a, b)
        return known

    def _read(self, a: int, b: int) -> bool:
        born, before = self.born, len(self.labels)
        while True:
            # The cell as it stood when merges of rank below ``before`` were in.
            if self.cut.get(a << 20 | b, before) < before:
                return False
            if born[b] >= born[a]:
                if born[b] < 0:
                    return True
                before = born[b] + 1  # column copied after the cut
                b = self.column[b]
            else:
                before = born[a]  # row copied before the cut
                a = self.row[a]

    def _spell(self, data: list[int], token: int, ends: bool) -> None:
        node = 0
        for byte in data:
            if byte not in self.next[node]:
                self.next[node][byte] = len(self.next)
                self.next.append({})
                self.inner.append(-1)
                self.final.append(-1)
            node = self.next[node][byte]
        (self.final if ends else self.inner)[node] = token

    def walk(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n, follow, inner, arcs = len(word), self.next, self.inner, self.arcs
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            node, before = 0, last[start] << 20
            for end in range(start + 1, n + 1):
                node = follow[node].get(word[end - 1])
                if node is None:
                    break
                if last[end] >= 0:
                    continue
                token = inner[node] if end < n else self.final[node]
                if token < 0:
                    continue
                if start:
                    ok = arcs.get(before | token)
                    if ok is None:
                        ok = self.arc(last[start], token)
                    if not ok:
                        continue
                last[end], begin[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = begin[at]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        if word in self.special:
            return struct.pack("<I", self.special[word])
        found = self.walk(word.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        if len(self.arcs) > CACHE_ARCS:
            self.arcs.clear()
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed."""
        words = self.split(text)
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.encode_word(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def split(self, text: str | None) -> list[str]:
        """Words of a text after normalisation; white space only separates them, so it may stay as it is."""
        if not text:
            return []
        words: list[str] = []
        for i, part in enumerate(_pieces(text, self.special)):
            if i % 2:
                words.append(part)
            elif part.isascii():
                words += _WORD.findall(part.lower())
            elif _FAR.search(part) and _NEWER.search(part):
                words += self._split_newer(part)
            else:
                words += _WORD.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return words

    def _split_newer(self, text: str) -> list[str]:
        """Words of a text with characters newer than Python's tables, split by the public library."""
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path)
        plain = self.splitter.normalizer.normalize_str(text)
        pieces = self.splitter.pre_tokenizer.pre_tokenize_str(plain)
        return [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in pieces]

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


_WORD = regex.compile(PATTERN)


def _unassigned() -> str:
    """A character class of the code points that Python's Unicode tables do not know."""
    edges, before = [], False
    for c in range(128, sys.maxunicode + 2):
        now = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if now != before:
            edges.append(c - before)
        before = now
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(edges[::2], edges[1::2])) + "]"


_NEWER = re.compile(_unassigned())
_FAR = re.compile("[\u0530-\U0010ffff]")  # older scripts need no closer look


def _pieces(text: str, special: dict[str, int]) -> list[str]:
    """Plain parts at even places, special tokens between them."""
    if not special or "<|" not in text:
        return [text]
    return regex.split("(" + "|".join(map(regex.escape, special)) + ")", text)


def load(path: str) -> Automaton:
    """Compile a vocabulary file (JSON with ``model.vocab``, ``model.merges`` and ``added_tokens``)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    return Automaton(data["model"]["vocab"], merges, special, path)


_compiled: dict[tuple[str, int], Automaton] = {}


def automaton(path: str) -> Automaton:
    """The compiled automaton, once per Python worker."""
    key = (path, os.getpid())
    if key not in _compiled:
        _compiled[key] = load(path)
    return _compiled[key]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, packed ``ids`` and the ``decoded`` text of every row: a narrow map."""
    path = path or default_path()

    def run(texts: list[str | None]) -> dict:
        machine = automaton(path)
        ids = [machine.encode(t) for t in texts]
        return {"ids": ids, "decoded": [machine.decode(i) for i in ids]}

    return map_texts(docs, run, "ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text, made next to the texts so that neither is moved."""
    path = path or default_path()

    def run(texts: list[str | None]) -> dict:
        machine = automaton(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:
            ids = machine.encode(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
        return out

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
