"""Piece encoding of merge-type vocabularies by a score-ordered agenda.

A text is made ready as the vocabulary wants it: a space before it, spaces and U+2581 as one letter,
here the space. Each character is one symbol of a doubly linked list. The agenda holds the adjacent pairs whose
joint letters are a piece, best score first and leftmost among equals. Taking a pair joins its
two symbols, if both still are what they were, and enters the two new neighbours of the joint
symbol. What is left when the agenda is empty are the tokens; a symbol that is no piece falls
back to its bytes, or to the unknown id if the vocabulary has no byte pieces.

No piece holds the characters on both sides of a border between two chunks (``chunk_pattern``), so no
merge crosses it: agendas of chunks give what one agenda of the text gives, and short chunks met before
are looked up. The short chunks that some texts hold and that were not met before go through their agendas
side by side, one row of a matrix each: a round takes the best pair of every row that still has one
(``agendas``). A chunk of any length is encoded whole, in n log n steps.

``checked`` runs the public sentencepiece library beside it in the same Arrow batches and tells
row by row whether ids and decoded text agree.

Supported are vocabularies without user-defined symbols and with the identity normaliser that
keeps repeated spaces; any other one shows up in ``checked``.

Defined results: NULL counts as the empty text, whose only token is the end id. Control symbols
written out in a text are ordinary text. Each row gives one row, in place, repeated or not; an
empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from itertools import chain, groupby

import numpy as np
from pyspark.sql import DataFrame

from tapeline.llm.common import map_texts

SPACE = "▁"  # fixed value: how the vocabulary writes a space
UNKNOWN = " ⁇ "  # fixed value: the decoded unknown id
CACHE_CHUNKS = 400_000  # in each half
CACHE_LENGTH = 40
SHORT = 32  # symbols; up to here looking at every pair beats a heap
WIDTHS = (4, 6, 8, 10, 12, 16, 24, SHORT)  # symbols; chunks of like length share a matrix
FEW = 100  # chunks; up to here one after the other beats matrices
PART_CHARS = 2_000_000  # texts whose chunks are held at once; a longer text is a part of its own
NEVER = float("inf")


def default_path() -> str:
    """The public vocabulary file; another merge-type model may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """Each byte that starts no character becomes one replacement sign."""
    return "�", error.start + 1


codecs.register_error("tapeline-each-byte", _each_byte)


class Joints:
    """Letters and pieces as numbers, and which two join to which; the pieces of several letters come first, best score first."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float]):
        wide = sorted((p for p in ids if len(p) > 1), key=rank.__getitem__)
        letters = sorted({c for p in ids for c in p})
        number = {p: i for i, p in enumerate([*wide, *letters])}
        self.other = len(number)  # a letter that no piece holds
        self.none = self.other + 1  # no symbol, no joint
        self.ids = [*map(ids.get, number), None]
        self.letter = np.full(0x110000, self.other, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(wide), len(number))
        _, level, sharing = np.unique([rank[p] for p in wide], return_inverse=True, return_counts=True)
        self.level = np.full(self.none + 1, self.none, np.int32)  # equal for equal scores
        self.level[:len(wide)] = level
        self.tied = np.zeros(self.none + 1, bool)
        self.tied[:len(wide)] = sharing[level] > 1
        pairs = {}
        for i, p in enumerate(wide):
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] * (self.none + 1) + number[p[k:]]] = i
        # A hash table with at least three free cells beside each pair; a pair whose cell is taken goes to the next free one.
        bits = (4 * len(pairs) + 1).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.joint = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, at in zip(pairs, self._cells(keys).tolist()):
            while self.keys[at] >= 0:
                at = (at + 1) & self.last
            self.keys[at], self.joint[at] = key, pairs[key]

    def _cells(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each two symbols join to, or none."""
        key = left.ravel().astype(np.int64) * (self.none + 1) + right.ravel()
        at = self._cells(key)
        held, out = self.keys[at], self.joint[at]
        other = np.flatnonzero(held != key)
        out[other] = self.none
        other = other[held[other] >= 0]
        while len(other):  # the next cells, up to the pair or a free cell
            at[other] = (at[other] + 1) & self.last
            held = self.keys[at[other]]
            found = held == key[other]
            out[other[found]] = self.joint[at[other[found]]]
            other = other[~found & (held >= 0)]
        return out.reshape(left.shape)


class Memory(dict):
    """Ids of chunks met before; a chunk not held gets an empty list, to be filled, and waits."""

    def __init__(self):
        self.waiting: dict[str, list[int]] = {}

    def __missing__(self, chunk: str) -> list[int]:
        ids = self.waiting.get(chunk)
        if ids is None:
            ids = self.waiting[chunk] = []
        return ids


class Pieces:
    """A merge-type vocabulary: ids and scores of pieces, bytes, and the chunks met so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.unknown = library.eos_id(), library.unk_id()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.unused: set[str] = set()
        self.byte_ids = [self.unknown] * 256
        self.surface: list[str] = []
        self.data: list[bytes] = []
        self.byte_of: dict[int, int] = {}
        self.control: set[int] = set()
        for i in range(library.vocab_size()):
            piece = library.id_to_piece(i)
            text = piece.replace(SPACE, " ")
            if library.is_byte(i):
                self.byte_of[i] = int(piece[1:-1], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif library.is_control(i):
                self.control.add(i)
                text = ""
            elif library.is_unknown(i):
                text = UNKNOWN
            else:
                self.ids[text] = i
                self.rank[text] = -library.get_score(i)
                if library.is_unused(i):
                    self.unused.add(text)
            self.surface.append(text)
            self.data.append(bytes([self.byte_of[i]]) if i in self.byte_of else text.encode())
        self.spelled = [None if i in self.control else d for i, d in enumerate(self.data)]
        self.numbers = [str(i) for i in range(len(self.surface))]
        self.chunks = re.compile(self.chunk_pattern(), re.DOTALL)
        self.known, self.older = Memory(), {}

    def chunk_pattern(self) -> str:
        """Spaces with the letters of one family after them, spaces alone, or one character that no longer piece holds.

        Characters that stand side by side in a piece are of one family.
        """
        above: dict[str, str] = {}

        def head(c: str) -> str:
            while above.setdefault(c, c) != c:
                c = above[c]
            return c

        for piece in self.ids:
            letters = piece.lstrip(" ")
            if " " in letters:
                return ".+"  # this piece reaches over a later space: the text is one chunk
            if len(piece) > 1 and letters:
                head(letters[0])
            for a, b in zip(letters, letters[1:]):
                above[head(a)] = head(b)
        families: dict[str, list[str]] = {}
        for c in sorted(above):
            families.setdefault(head(c), []).append(c)
        widest = sorted(families.values(), key=len, reverse=True)
        return "|".join([*(f" *[{re.escape(''.join(f))}]+" for f in widest), " +", "."])

    @cached_property
    def joints(self) -> Joints:
        return Joints(self.ids, self.rank)

    def agendas(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """``short_agenda`` of many chunks of up to ``SHORT`` symbols: in each round every chunk joins its best pair."""
        joints, out = self.joints, [()] * len(chunks)
        none, sizes = joints.none, np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        starts = [0, *np.searchsorted(sizes[order], WIDTHS, "right").tolist()]
        for width, start, stop in zip(WIDTHS, starts, starts[1:]):
            rows = order[start:stop]
            letters = "".join(map(chunks.__getitem__, rows.tolist())).encode("utf-32-le", "surrogatepass")
            # Nothing stands before and after the symbols of a row; score i is that of symbols i and i + 1.
            symbols = np.full((len(rows), width + 2), none, np.int32)
            symbols[:, 1:-1][np.arange(width) < sizes[rows, None]] = joints.letter[np.frombuffer(letters, np.uint32)]
            best = joints.join(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                at = best.argmin(axis=1)
                joint = best[np.arange(len(rows)), at]
                ready = joint == none
                if ready.any():
                    self._put(out, rows[ready], symbols[ready])
                    more = ~ready
                    rows, symbols, best, at, joint = rows[more], symbols[more], best[more], at[more], joint[more]
                line, tied = np.arange(len(rows)), np.flatnonzero(joints.tied[joint])
                if len(tied):  # the leftmost of equal scores
                    at[tied] = joints.level[best[tied]].argmin(axis=1)
                    joint[tied] = best[tied, at[tied]]
                symbols, best = _without(symbols, at + 1), _without(best, at)
                symbols[line, at] = joint
                best[line, at - 1] = joints.join(symbols[line, at - 1], joint)
                best[line, at] = joints.join(joint, symbols[line, at + 1])
        for i, ids in enumerate(out):
            if None in ids:
                out[i] = self.short_agenda(chunks[i])
        return out

    def _put(self, out: list[tuple], rows: np.ndarray, symbols: np.ndarray) -> None:
        """The ids of each row of symbols to its place in ``out``."""
        there = symbols != self.joints.none
        ids = [*map(self.joints.ids.__getitem__, symbols[there].tolist())]
        start = 0
        for row, stop in zip(rows.tolist(), there.sum(axis=1).cumsum().tolist()):
            out[row] = tuple(ids[start:stop])
            start = stop

    def short_agenda(self, chunk: str) -> tuple[int, ...]:
        """``agenda`` for a few symbols: pair scores lie beside the symbols, the best is found by looking at each."""
        rank = self.rank
        symbols = list(chunk)
        scores = [rank.get(p, NEVER) for p in map(str.__add__, chunk, chunk[1:])]
        while scores:
            best = min(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            joint = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del scores[at]
            if at < len(scores):
                scores[at] = rank.get(joint + symbols[at + 1], NEVER)
            if at:
                scores[at - 1] = rank.get(symbols[at - 1] + joint, NEVER)
        ids = tuple(map(self.ids.get, symbols))
        if None in ids:
            out: list[int] = []
            for symbol in symbols:
                self._emit(symbol, {}, out)
            ids = tuple(out)
        return ids

    def agenda(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk."""
        rank, n, unused = self.rank, len(chunk), self.unused
        push, pop = heapq.heappush, heapq.heappop
        symbols: list[str] = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        halves: dict[str, tuple[str, str]] = {}
        pairs = [(rank[p], i, p) for i, p in enumerate(map(str.__add__, chunk, chunk[1:])) if p in rank]
        if unused:
            halves = {p: (p[0], p[1]) for _, _, p in pairs}
        heapq.heapify(pairs)
        while pairs:
            _, left, joint = pop(pairs)
            a, right = symbols[left], after[left]
            if not a or right >= n or a + symbols[right] != joint:
                continue  # one of the two was joined meanwhile
            symbols[left], symbols[right] = joint, ""
            follow = after[left] = after[right]
            before[follow] = left
            if follow < n:
                wider = joint + symbols[follow]
                if wider in rank:
                    push(pairs, (rank[wider], left, wider))
                    if unused:
                        halves[wider] = (joint, symbols[follow])
            ahead = before[left]
            if ahead >= 0:
                wider = symbols[ahead] + joint
                if wider in rank:
                    push(pairs, (rank[wider], ahead, wider))
                    if unused:
                        halves[wider] = (symbols[ahead], joint)
        out: list[int] = []
        for symbol in symbols:
            if symbol in self.ids and symbol not in unused:
                out.append(self.ids[symbol])
            elif symbol:
                self._emit(symbol, halves, out)
        return tuple(out)

    def _emit(self, symbol: str, halves: dict[str, tuple[str, str]], out: list[int]) -> None:
        """The id of a symbol, the ids of the halves of an unused piece, or the bytes."""
        wait = [symbol]
        while wait:
            now = wait.pop()
            if now in self.unused and now in halves:
                wait += reversed(halves[now])
            elif now in self.ids:
                out.append(self.ids[now])
            elif self.byte_of:
                out += [self.byte_ids[b] for b in now.replace(" ", SPACE).encode()]
            else:
                out.append(self.unknown)

    def _meet(self) -> None:
        """Fills in the ids of the chunks that wait; a full younger half of the memory becomes the older one."""
        waiting, self.known.waiting = self.known.waiting, {}
        fresh = []
        for chunk, slot in waiting.items():
            ids = self.older.get(chunk)
            if ids is None:
                fresh.append(chunk)
            else:
                slot += ids
                self._keep(chunk, ids)
        if len(fresh) > FEW and not self.unused:
            short = [c for c in fresh if len(c) <= SHORT]
            found = zip(chain(short, long := [c for c in fresh if len(c) > SHORT]), chain(self.agendas(short), map(self.agenda, long)))
        else:
            found = ((c, self.agenda(c) if len(c) > SHORT or self.unused else self.short_agenda(c)) for c in fresh)
        for chunk, ids in found:
            waiting[chunk] += ids
            self._keep(chunk, ids)

    def _keep(self, chunk: str, ids: tuple[int, ...]) -> None:
        if len(chunk) <= CACHE_LENGTH:
            if len(self.known) >= CACHE_CHUNKS:
                self.older, self.known = self.known, Memory()
            self.known[chunk] = ids

    def _encode_part(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, without the end id."""
        find, look = self.chunks.findall, self.known.__getitem__
        found = [list(map(look, find(" " + t.replace(SPACE, " ")))) if t else () for t in texts]
        self._meet()
        for ids in found:
            yield list(chain.from_iterable(ids))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of whole texts, each with the end id."""
        part: list[str] = []
        size = 0
        for at, text in enumerate(texts, 1):
            part.append(text or "")
            size += len(part[-1])
            if size >= PART_CHARS or at == len(texts):
                for ids in self._encode_part(part):
                    ids.append(self.end)
                    yield ids
                part, size = [], 0

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """Ids of a whole text, with the end id unless told otherwise."""
        ids, = self._encode_part([text or ""])
        if end:
            ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: letters of pieces, runs of bytes read as UTF-8, the first space taken off again."""
        if ids and ids[-1] in self.control:
            ids = ids[:-1]
        try:
            text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "tapeline-each-byte")
        except TypeError:  # a control id ends a run of bytes
            runs = [list(run) for silent, run in groupby(ids, self.control.__contains__) if not silent]
            text = "".join(b"".join(map(self.data.__getitem__, run)).decode("utf-8", "tapeline-each-byte") for run in runs)
            ids = runs[0] if runs else []
        if not ids:
            return ""
        first = ids[0]
        return text[1:] if first not in self.byte_of and first != self.unknown and text.startswith(" ") else text


def _without(matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The matrix less one cell of each row."""
    keep = np.ones(matrix.shape, bool)
    keep[np.arange(len(at)), at] = False
    return matrix[keep].reshape(len(at), matrix.shape[1] - 1)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Encoding makes no reference cycles: the search for them, over all the lists of a batch again and again, waits for its end."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_loaded: dict[tuple[str, int], Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary, once per Python worker."""
    key = (path, os.getpid())
    if key not in _loaded:
        _loaded[key] = Pieces(path)
    return _loaded[key]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` with the end id, and the ``decoded`` text of every row: a narrow map."""
    path = path or default_path()

    def run(texts: list[str | None]) -> dict:
        with _no_cycles():
            vocabulary = pieces(path)
            ids = list(vocabulary.encode_all(texts))
            return {"ids": ids, "decoded": [vocabulary.decode(i) for i in ids]}

    return map_texts(docs, run, "ids array<long>, decoded string")


def checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count, digests and ``agrees``: whether the public library gives the same ids and the same decoded text."""
    path = path or default_path()

    def run(texts: list[str | None]) -> dict:
        with _no_cycles():
            return digests(pieces(path), texts)

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")


def digests(vocabulary: Pieces, texts: list[str | None]) -> dict[str, list]:
    """The columns of ``checked`` for some texts."""
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "agrees": []}
    theirs = vocabulary.library.encode([t or "" for t in texts], add_eos=True, num_threads=1, return_type="numpy")
    for ids, expected in zip(vocabulary.encode_all(texts), theirs):
        decoded = vocabulary.decode(ids)
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(" ".join(map(vocabulary.numbers.__getitem__, ids)).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        out["agrees"].append(np.array_equal(array("i", ids), expected) and decoded == vocabulary.library.decode(ids))
    return out


def op12_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` encoded and decoded, checked against the library in its batch."""
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
