"""Alignment of two tokenizers by pointer jumping.

The tokens of both encodings of a text are intervals over the same bytes. Every token points to
the farthest-right token that overlaps it: a token of A to the token of B over its last byte, a
token of B to the token of A over its last byte, and to itself when both end there. Replacing
each pointer by its target's pointer, for all tokens of a run of texts at once, doubles the reach
of every pointer; after about log2 of the longest chain all point to the last token of their
component. Components are the groups of the alignment, and each ends at a byte where a token of A
and a token of B both end: that pair is the group's link.

Bytes of two linked tokens end alike, so one token is a suffix of the other. That bounds the
pairs that can ever be linked by the two vocabularies alone, whatever the corpus: ``Pairs`` numbers
them, and counts of all of them are small enough to be added up on the driver and sent to every task.

``aligned`` encodes a text once and keeps its links as such numbers; the corpus-wide counts
are added up from them, and ``scored`` reads them again beside the counts.

Defined results: texts that are NULL or empty, and texts whose tokens do not spell a space and the
text byte by byte, have no tokens, no groups and no links. Repeated rows and ids count each; an
empty table gives no rows; other columns are ignored whatever their names. Texts of any length
are aligned whole; runs of texts are cut by bytes (``RUN_BYTES``).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import pieces
from tapeline.llm.bpe import _byte_letters
from tapeline.llm.common import map_texts
from tapeline.session import materialize

RUN_BYTES = 1 << 20


def default_paths() -> tuple[str, str]:
    """The public byte-level vocabulary (A) and the public piece vocabulary (B)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), pieces.default_path()


# Fixed value: how a byte-level vocabulary splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 500
_LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


class ByteLevel:
    """A byte-level vocabulary file: the bytes of every id (special tokens have none), and encoding without special tokens.

    Where merges come in the order of their ids, as in the public file, the faster of two public libraries encodes;
    the other one takes files of another order, and texts with very long runs, which it alone encodes in bounded time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        special = {t["id"] for t in data["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *special]) + 1)
        for token, i in vocab.items():
            if i not in special:
                self.tokens[i] = bytes(byte_of[c] for c in token)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.fast = None
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        ready = data["pre_tokenizer"] or {}
        if joined == sorted(joined) and ready.get("type") == "ByteLevel" and ready.get("use_regex") and not data["normalizer"]:
            import tiktoken

            ranks = {token: i for i, token in enumerate(self.tokens) if token}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or max(map(len, text.split()), default=0) >= LONG_RUN or _LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _twins(tokens: list[bytes]) -> np.ndarray:
    """How many earlier tokens are spelled alike."""
    seen: dict[bytes, int] = {}
    out = np.zeros(len(tokens), np.int64)
    for i, token in enumerate(tokens):
        out[i] = seen.get(token, 0) if token else 0
        seen[token] = out[i] + 1
    return out


class Pairs:
    """Places for all pairs of a token of A and a token of B of which one ends the other.

    The longer token and the length of the shorter one tell a pair, up to tokens that are spelled alike. So there
    are as many places as the tokens have bytes, and a place is found by arithmetic.
    """

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.tokens = a_tokens, b_tokens
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in self.tokens)
        self.a_twin, self.b_twin = _twins(a_tokens), _twins(b_tokens)
        self.a_kinds, self.b_kinds = int(self.a_twin.max()) + 1, int(self.b_twin.max()) + 1
        b_places, a_places = self.b_size * self.a_kinds, self.a_size * self.b_kinds
        self.b_base = np.concatenate(([0], np.cumsum(b_places)[:-1]))
        self.a_base = b_places.sum() + np.concatenate(([0], np.cumsum(a_places)[:-1]))
        self.size = int(b_places.sum() + a_places.sum())

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        short, long = self.a_size[a], self.b_size[b]
        in_b = self.b_base[b] + self.a_kinds * (short - 1) + self.a_twin[a]
        in_a = self.a_base[a] + self.b_kinds * (long - 1) + self.b_twin[b]
        return np.where(short <= long, in_b, in_a)

    def b_ids(self) -> np.ndarray:
        """The token of B of each place; -1 where there is none."""
        a_tokens, b_tokens = self.tokens
        out = np.full(self.size, -1, np.int64)
        out[: int(self.a_base[0])] = np.repeat(np.arange(len(b_tokens)), self.b_size * self.a_kinds)
        spelled: dict[bytes, list[int]] = {}
        for i, token in enumerate(b_tokens):
            if token:
                spelled.setdefault(token, []).append(i)
        for i, token in enumerate(a_tokens):
            for length in range(1, len(token)):
                for j in spelled.get(token[-length:], ()):
                    out[self.a_base[i] + self.b_kinds * (length - 1) + self.b_twin[j]] = j
        return out


def terminals(a_ends: np.ndarray, b_ends: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """For every token, A's before B's, the last token of its component; ends grow and both lists end alike."""
    n_a = len(a_ends)
    a_at, b_at = np.repeat(np.arange(n_a), a_size), np.repeat(np.arange(len(b_ends)), b_size)  # the token over each byte
    over_b = a_at[b_ends - 1]
    own = np.arange(n_a, n_a + len(b_ends))
    points = np.concatenate([b_at[a_ends - 1] + n_a, np.where(a_ends[over_b] == b_ends, own, over_b)])
    while True:
        further = points[points]
        if np.array_equal(further, points):
            return points
        points = further


class Aligner:
    """Both encoders, the bytes of their tokens, and the pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        self.first = ByteLevel(a_path)
        self.second = pieces.pieces(b_path)
        self.a_tokens = self.first.tokens
        self.b_tokens = [b"" if i in self.second.control else t for i, t in enumerate(self.second.data)]
        self.pairs = Pairs(self.a_tokens, self.b_tokens)
        # How a token is written in the list of groups, by what follows it: a token of A, the tokens of B; a token of B, the next group.
        a, b = len(self.a_tokens), len(self.b_tokens)
        self.written = [f"{i}{end}" for n, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(n)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both; both empty unless each spells a space and the text."""
        spaced = [" " + t for t in texts]
        none = np.empty(0, np.int64)
        out = []
        theirs = self.second.library.encode(texts, num_threads=1)
        for text, b in zip(spaced, theirs):
            a, data = self.first.encode(text), text.encode()
            fits = len(text) > 1 and b"".join(map(self.a_tokens.__getitem__, a)) == data == b"".join(map(self.b_tokens.__getitem__, b))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if fits else (none, none))
        return out

    def run(self, texts: list[str]) -> Iterator[dict]:
        """Groups and links of each text; the texts are laid end to end and aligned at once."""
        both = self.encode(texts)
        a = np.concatenate([a for a, _ in both])
        b = np.concatenate([b for _, b in both])
        a_size, b_size = self.pairs.a_size[a], self.pairs.b_size[b]
        a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
        last = terminals(a_ends, b_ends, a_size, b_size) - len(a)
        # The last token of B names a component; its last token of A ends at the same byte.
        closing = last[len(a):] == np.arange(len(b))
        closes_b, upto_b = np.flatnonzero(closing), np.cumsum(closing)
        number = upto_b - 1
        group_a, group_b = number[last[:len(a)]], number[last[len(a):]]
        closes_a = np.flatnonzero(np.diff(group_a, append=-1))
        places = self.pairs.places(a[closes_a], b[closes_b]).astype(np.int32)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[closes_a], ends_b[closes_b] = 1, 1
        wide_a, wide_b = len(self.a_tokens), len(self.b_tokens)
        codes = np.concatenate([a + wide_a * ends_a, 2 * wide_a + b + wide_b * ends_b])
        # Group by group, A's tokens before B's, each side in its own order.
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        codes = codes[order].tolist()
        sizes_a, sizes_b = [len(x) for x, _ in both], [len(y) for _, y in both]
        ends = np.cumsum(sizes_b)
        groups = np.where(ends > 0, upto_b[ends - 1], 0).tolist() if len(b) else [0] * len(both)
        tokens = group = 0
        for n_a, n_b, upto in zip(sizes_a, sizes_b, groups):
            stop = tokens + n_a + n_b
            listed = "".join(map(self.written.__getitem__, codes[tokens:stop]))[:-1]
            yield {"n_a": n_a, "n_b": n_b, "n_groups": upto - group, "groups": listed, "links": places[group:upto]}
            tokens, group = stop, upto

    def texts(self, texts: list[str | None]) -> Iterator[dict]:
        """``run`` over as many texts at a time as hold about ``RUN_BYTES``."""
        wait: list[str] = []
        size = 0
        for text in texts:
            wait.append(text or "")
            size += len(wait[-1])
            if size >= RUN_BYTES:
                yield from self.run(wait)
                wait, size = [], 0
        if wait:
            yield from self.run(wait)


_made: dict[tuple[str, str, int], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """Both vocabularies, once per Python worker."""
    key = (*paths, os.getpid())
    if key not in _made:
        _made[key] = Aligner(*paths)
    return _made[key]


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id``, token and group counts, the ``groups`` as text, and ``links``: places in ``Pairs``, packed 32-bit integers."""
    return _aligned(docs, paths, False)


def _aligned(docs: DataFrame, paths: tuple[str, str] | None, digest: bool) -> DataFrame:
    paths = paths or default_paths()
    name = "groups_sha256" if digest else "groups"

    def run(texts: list[str | None]) -> dict:
        out: dict[str, list] = {"n_a": [], "n_b": [], "n_groups": [], name: [], "links": []}
        for row in aligner(paths).texts(texts):
            row["links"] = row["links"].tobytes()
            groups = row.pop("groups")
            row[name] = hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups
            for key, value in row.items():
                out[key].append(value)
        return out

    return map_texts(docs, run, f"n_a long, n_b long, n_groups long, {name} string, links binary")


def link_counts(links: DataFrame) -> DataFrame:
    """How many ``links`` hold each place: summed per batch, then per task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            places, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_pydict({"place": pa.array(places.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})

    partial = links.select("links").mapInArrow(run, "place long, n long")
    return partial.groupBy("place").agg(F.sum("n").alias("n"))


def pair_counts(rows: DataFrame, paths: tuple[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Count of every pair, and whether it is the highest of its B id.

    Both have one value for each place of ``Pairs``, a number that the vocabularies fix (below a million for the
    public ones), not the corpus.
    """
    pairs = aligner(paths or default_paths()).pairs
    counts = np.zeros(pairs.size, np.int64)
    summed = link_counts(rows).toArrow()
    counts[summed["place"].to_numpy()] = summed["n"].to_numpy()
    b = pairs.b_ids()
    highest = np.zeros(len(pairs.b_size), np.int64)
    np.maximum.at(highest, b[b >= 0], counts[b >= 0])
    return counts, (counts == highest[b]) & (counts > 0)


def scored(rows: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """``rows`` with ``n_links``, ``n_best`` and ``count_sum`` in place of ``links``."""
    sent = rows.sparkSession.sparkContext.broadcast((counts, best))  # of a size that the vocabularies fix
    kept = [f for f in rows.schema.fields if f.name != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            found = [np.frombuffer(x, np.int32) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(i) for i, f in enumerate(kept)} | {
                "n_links": pa.array([len(x) for x in found], pa.int64()),
                "n_best": pa.array([int(best[x].sum()) for x in found], pa.int64()),
                "count_sum": pa.array([int(counts[x].sum()) for x in found], pa.int64()),
            })

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f.name for f in kept], "links").mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Every document's counts, digest of its groups, and how its links rank in the whole table."""
    rows = materialize(_aligned(docs, paths, True))
    return scored(rows, *pair_counts(rows, paths))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Both public tokenizers over every document of ``documents``."""
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
