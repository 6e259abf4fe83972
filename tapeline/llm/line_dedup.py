"""Line dedup by an exact set-similarity join.

A line is the set of its words; two lines match at a Jaccard similarity of 4/5 or more.
Lines with equal sets form one class. A line goes when an earlier line (by ``doc_id``, hash of
the row's text, then line number) is of its class or of a class that matches its own; that earlier line may itself
have gone. The join finds every class with an earlier match:

1. One pass counts words in a fixed-size count-min sketch.
2. Words are ordered by rarity (sketch count, then hash). By the prefix filter, matching
   lines share one of their rarest ``n - ceil(4n/5) + 1`` words. Those entries go to parts by
   word; in a part, entries of one word meet within their length window and pass the
   positional filter and a 128-bit parity bitmap (its difference never exceeds that of the sets).
   The same pass names lines after the first of their class: at once within a batch of chunks,
   and between batches in a part by class, which gets one line of a class from each batch.
3. Surviving pairs are verified on the full sets of word hashes.

A class first sends, from each part, only the ``FIRST`` earlier candidates with the closest bitmaps.
If it had more, the part keeps the entries of that word; classes without a match then send
all the rest from those, so that thousands of variants of one line cost thousands of pairs,
not millions, and no match is lost.

Data between the steps is packed: one row per chunk of text and part. The number of parts follows
the number of words, and an entry carries no text. Documents are joined with the numbers of
the lines that go, on id and hash of the text, by broadcast if those were counted to be few, else by shuffle.

Defined results: NULL and empty texts stay as they are; lines without a word always stay; rows
with equal ``doc_id`` are told apart by their text; rows equal in both are judged alike (lines of
equal number tie, and ties stay); NULL ``doc_id`` comes first; other columns pass through
whatever their names; an empty table gives no rows; lines of any length are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tapeline.llm.common import WIDTH, bound_batches, broadcast_if_few, document_id, free_name, row_ids, row_texts, sketch_slots, text_hash, total_sketch
from tapeline.llm.words import chunks, doc_words, hash_words, mix
from tapeline.session import materialize

NUMERATOR, DENOMINATOR = 4, 5
FIRST = 8
FLUSH = 32  # records of this many chunks go out together
PART_ENTRIES = 400_000
WINDOW_PAIRS = 1 << 20

KEPT_ENTRIES = 10_000  # in one row
_LINE = np.dtype([("ka", "<u8"), ("kb", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("line", "<u4")])
_ENTRY = np.dtype([
    ("token", "<u4"), ("n", "<u4"), ("ka", "<u8"), ("kb", "<u8"), ("kc", "<u8"),
    ("doc", "<i8"), ("row", "<i8"), ("line", "<u4"), ("at", "<u4"),
])


def least_common(a, b):
    """The words that two sets of these sizes share at least when they match."""
    top, bottom = NUMERATOR, NUMERATOR + DENOMINATOR
    return (top * (a + b) + bottom - 1) // bottom


def prefix_length(n):
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def line_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the global line index of each, and each line's document and number."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts)
    starts, hashes = hash_words(data)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    first = np.searchsorted(breaks, begins)  # index of each document's first line
    of_line = np.searchsorted(first, np.arange(len(breaks) + 1), side="right") - 1
    return hashes, line, of_line, np.arange(len(breaks) + 1) - first[of_line]


def line_sets(hashes: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line by (line, rank, hash): hashes, starts of lines, line indexes."""
    if not len(hashes):
        return hashes, np.zeros(0, int), np.zeros(0, int)
    key = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))
    order = np.argsort(key)
    h, k = hashes[order], key[order]
    same = k[1:] == k[:-1]
    if line[-1] >= 1 << 20 or (same & (h[1:] != h[:-1])).any():
        order = np.lexsort((hashes, rank, line))
        h = hashes[order]
        same = (h[1:] == h[:-1]) & (line[order][1:] == line[order][:-1])
    keep = np.concatenate(([True], ~same))
    h, of = h[keep], line[order][keep]
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return h, starts, of[starts]


def identities(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """192 bits that name a set: a sum of hashes and the two halves of its parity bitmap."""
    bit = np.uint64(1) << (h & np.uint64(63))
    upper = (h >> np.uint64(6)) & np.uint64(1) == 1
    zero = np.uint64(0)
    return (
        np.add.reduceat(mix(h + np.uint64(11)), starts),
        np.bitwise_xor.reduceat(np.where(upper, zero, bit), starts),
        np.bitwise_xor.reduceat(np.where(upper, bit, zero), starts),
    )


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sketch cells of all words."""
    cells = np.zeros(2 * WIDTH, np.int64)
    for frame in frames:
        texts = row_texts(frame)
        for a, b in chunks(texts):
            for slot in sketch_slots(doc_words(texts[a:b])[0]):
                cells += np.bincount(slot, minlength=2 * WIDTH)
    used = np.flatnonzero(cells)
    yield pd.DataFrame({"cell": used, "n": cells[used]})


def _later_copies(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines by class, document, row and number: those that begin a class, and those after its first place.

    Lines at the first place of their class tie and stay.
    """
    copy = (lines["ka"][1:] == lines["ka"][:-1]) & (lines["kb"][1:] == lines["kb"][:-1])
    heads = np.concatenate(([True], ~copy))
    first = lines[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
    return heads, (lines["doc"] != first["doc"]) | (lines["row"] != first["row"]) | (lines["line"] != first["line"])


def _by_class(lines: np.ndarray) -> np.ndarray:
    return lines[np.lexsort((lines["line"], lines["row"], lines["doc"], lines["kb"], lines["ka"]))]


def _earliest(entries: np.ndarray) -> np.ndarray:
    """One entry for each word and class, that of its earliest line."""
    key = entries["ka"] ^ mix(entries["token"].astype(np.uint64))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    if not again.any():
        return entries
    rows = entries[order[again]]
    rows = rows[np.lexsort((rows["line"], rows["row"], rows["doc"], rows["kb"], rows["ka"], rows["token"]))]
    repeated = (rows["token"][1:] == rows["token"][:-1]) & (rows["ka"][1:] == rows["ka"][:-1]) & (rows["kb"][1:] == rows["kb"][:-1])
    return np.concatenate((entries[order[~again]], rows[np.concatenate(([True], ~repeated))]))


def _packed(lines: list[np.ndarray], entries: list[np.ndarray], parts: int) -> Iterator[pd.DataFrame]:
    """One row per part for the records of several chunks.

    Entries go to parts of words (from 0), the first line of each class to parts of classes
    (from ``parts``), and lines that are sure to go to parts of any lines (from ``2 * parts``):
    a frequent line or word sends one record from each batch of chunks to its part.
    """
    dealt = []
    if lines:
        rows = _by_class(np.concatenate(lines))
        heads, gone = _later_copies(rows)
        dealt.append(((rows["ka"][heads] % np.uint64(parts)).astype(np.int64) + parts, rows[heads]))
        dealt.append(((rows["doc"][gone] + rows["row"][gone] + rows["line"][gone]) % parts + 2 * parts, rows[gone]))
    if entries:
        rows = _earliest(np.concatenate(entries))
        dealt.append(((mix(rows["token"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), rows))
    for part, rows in dealt:
        if not len(rows):
            continue
        order = np.argsort(part, kind="stable")
        part, rows = part[order], rows[order]
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        yield pd.DataFrame({
            "part": [int(part[i]) for i in edges[:-1]],
            "data": [rows[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])],
        })


def _entries(cells: np.ndarray, parts: int):
    """Prefix entries of all lines by word, and the lines by class."""
    rank_of = np.minimum(64 * np.log2(cells + 1.0), 4095).astype(np.uint16)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_lines, held = [], []
        for frame in frames:
            texts, ids, row_hashes = row_texts(frame), row_ids(frame), frame["row"].to_numpy(np.int64)
            for a, b in chunks(texts):
                if len(held) >= FLUSH:
                    yield from _packed(held_lines, held, parts)
                    held_lines, held = [], []
                hashes, line, doc, number = line_words(texts[a:b])
                if not len(hashes):
                    continue
                one, two = sketch_slots(hashes)
                h, starts, at = line_sets(hashes, line, np.minimum(rank_of[one], rank_of[two]))
                ka, kb, kc = identities(h, starts)
                where, which, number = ids[a:b][doc[at]], row_hashes[a:b][doc[at]], number[at]
                lines = np.empty(len(ka), _LINE)
                lines["ka"], lines["kb"], lines["doc"], lines["row"], lines["line"] = ka, kb, where, which, number
                held_lines.append(lines)
                n = np.diff(np.append(starts, len(h)))
                # Sets of under four words match equal sets only; a chunk sends the earliest line of each class.
                order = np.lexsort((number, which, where, kb, ka))
                fresh = (ka[order][1:] != ka[order][:-1]) | (kb[order][1:] != kb[order][:-1])
                fit = np.zeros(len(n), bool)
                fit[order[np.concatenate(([True], fresh))]] = True
                own = np.flatnonzero(fit & (n >= DENOMINATOR - 1))
                size = prefix_length(n[own])
                row = np.repeat(own, size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                word = h[starts[row] + place]
                one, two = sketch_slots(word)
                shared = np.minimum(cells[one], cells[two]) > 1  # a word seen once is in one line
                row, place, word = row[shared], place[shared], word[shared]
                out = np.empty(len(row), _ENTRY)
                out["token"] = (word >> np.uint64(32)).astype(np.uint32)
                out["n"], out["at"] = n[row], place
                out["ka"], out["kb"], out["kc"] = ka[row], kb[row], kc[row]
                out["doc"], out["row"], out["line"] = where[row], which[row], number[row]
                held.append(out)
        yield from _packed(held_lines, held, parts)

    return run


def _windows(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), j before i, of one word and within the length window, in bounded chunks."""
    step = rows["token"].astype(np.uint64) << np.uint64(32)
    key = step | rows["n"]
    least = step | ((NUMERATOR * rows["n"].astype(np.uint64) + np.uint64(DENOMINATOR - 1)) // np.uint64(DENOMINATOR))
    low = np.searchsorted(key, least)
    count = np.arange(len(rows)) - low
    total = np.cumsum(count)
    i = 0
    while i < len(rows):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + WINDOW_PAIRS, side="right")))
        if total[j - 1] > done:
            left = np.repeat(np.arange(i, j), count[i:j])
            inner = np.arange(len(left)) - np.repeat(total[i:j] - count[i:j] - done, count[i:j])
            yield left, low[left] + inner
        i = j


def _earlier(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d, e, f, g = rows["doc"][a], rows["doc"][b], rows["row"][a], rows["row"][b]
    return (d < e) | ((d == e) & ((f < g) | ((f == g) & (rows["line"][a] < rows["line"][b]))))


def candidates(rows: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of entries that pass the filters, and entries of later classes that had more.

    With ``wanted`` (``ka`` of classes), all pairs of those; else the ``FIRST`` closest of each class.
    """
    # One entry per word and class, the earliest of its lines.
    key = (rows["token"].astype(np.uint64) << np.uint64(32)) | rows["n"]
    rows = rows[np.lexsort((rows["ka"], key))]
    if len(rows):
        repeated = (rows["token"][1:] == rows["token"][:-1]) & (rows["ka"][1:] == rows["ka"][:-1]) & (rows["kb"][1:] == rows["kb"][:-1])
        heads = np.flatnonzero(np.concatenate(([True], ~repeated)))
        size = np.diff(np.append(heads, len(rows)))
        doc = np.minimum.reduceat(rows["doc"], heads)
        first = rows["doc"] == np.repeat(doc, size)
        row = np.minimum.reduceat(np.where(first, rows["row"], np.int64((1 << 63) - 1)), heads)
        first &= rows["row"] == np.repeat(row, size)
        line = np.minimum.reduceat(np.where(first, rows["line"], np.uint32(0xFFFFFFFF)), heads)
        rows = rows[heads].copy()
        rows["doc"], rows["row"], rows["line"] = doc, row, line
    ask = None if wanted is None else np.isin(rows["ka"], wanted)
    later, sooner, slack = [], [], []
    held = 0
    more = np.zeros(0, int)

    def thin() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, the closest first; unless ``wanted``, ``FIRST`` for each later class; and where there were more."""
        x, y, z = (np.concatenate(v) if v else np.zeros(0, int) for v in (later, sooner, slack))
        order = np.lexsort((rows["ka"][y], z, rows["ka"][x]))
        x, y, z = x[order], y[order], z[order]
        kx, ky = rows["ka"][x], rows["ka"][y]
        fresh = np.concatenate(([True], (kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])))[: len(x)]
        x, y, z, kx = x[fresh], y[fresh], z[fresh], kx[fresh]
        head = np.flatnonzero(np.concatenate(([True], kx[1:] != kx[:-1]))[: len(x)])
        nth = np.arange(len(x)) - np.repeat(head, np.diff(np.append(head, len(x))))
        keep = np.ones(len(x), bool) if ask is not None else nth < FIRST
        over = np.zeros(0, int) if ask is not None else x[~keep]
        return x[keep], y[keep], z[keep], over

    for i, j in _windows(rows):
        ni, nj = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
        common = least_common(ni, nj)
        left = np.minimum(ni - rows["at"][i], nj - rows["at"][j])
        near = left >= common
        i, j, room = i[near], j[near], (ni + nj - 2 * common)[near]
        apart = np.bitwise_count(rows["kb"][i] ^ rows["kb"][j]).astype(np.int64) + np.bitwise_count(rows["kc"][i] ^ rows["kc"][j])
        near = apart <= room
        i, j, z = i[near], j[near], (apart - room)[near]
        swap = _earlier(rows, i, j)
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        if ask is not None:
            i, j, z = i[ask[i]], j[ask[i]], z[ask[i]]
        later.append(i)
        sooner.append(j)
        slack.append(z)
        held += len(i)
        if held > 4 * WINDOW_PAIRS:
            x, y, z, over = thin()
            later, sooner, slack, more, held = [x], [y], [z], np.concatenate((more, over)), 0
    x, y, _, over = thin()
    more = np.concatenate((more, over))
    if len(more):
        # One row for each class and word that had more.
        more = more[np.unique(rows["ka"][more] ^ mix(rows["token"][more].astype(np.uint64)), return_index=True)[1]]
    return rows[x], rows[y], rows[more]


_PLACE = ["doc", "row", "line"]
_ENDS = ["ka", "kb", *_PLACE, "ea", "eb", "edoc", "erow", "eline"]
_PAIR = ", ".join(f"{c} long" for c in _ENDS)
_MET = f"kind int, part long, token long, {_PAIR}, data binary"
PAIR, MORE, COPY, KEPT = 0, 1, 2, 3


def _pair_rows(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    signed = lambda v: np.ascontiguousarray(v).view(np.int64)
    return pd.DataFrame({
        "ka": signed(x["ka"]), "kb": signed(x["kb"]), "doc": x["doc"], "row": x["row"], "line": x["line"].astype(np.int64),
        "ea": signed(y["ka"]), "eb": signed(y["kb"]), "edoc": y["doc"], "erow": y["row"], "eline": y["line"].astype(np.int64),
    })


def _met_rows(part: int, kind: np.ndarray | int, token: np.ndarray | int, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    made = _pair_rows(x, y)
    made.insert(0, "token", token)
    made.insert(0, "part", part)
    made.insert(0, "kind", kind)
    made["data"] = None
    return made


def _meet(parts: int):
    """From a part of words: candidate pairs, classes that had more, and the entries of their words; else: lines after the first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part, data = int(frame["part"].iloc[0]), b"".join(frame["data"])
        if part >= parts:
            lines = np.frombuffer(data, _LINE)
            if part < 2 * parts:
                lines = _by_class(lines)
                lines = lines[_later_copies(lines)[1]]
            return _met_rows(part, COPY, 0, lines, lines)
        rows = np.frombuffer(data, _ENTRY)
        x, y, more = candidates(rows)
        kind = np.repeat([PAIR, MORE], [len(x), len(more)])
        x, y = np.concatenate((x, more)), np.concatenate((y, more))
        met = _met_rows(part, kind, x["token"].astype(np.int64), x, y)
        if not len(more):
            return met
        rows = rows[np.isin(rows["token"], more["token"])]
        kept = [rows[i : i + KEPT_ENTRIES] for i in range(0, len(rows), KEPT_ENTRIES)]
        saved = pd.DataFrame({"kind": KEPT, "part": part, "token": 0, **dict.fromkeys(_ENDS, 0), "data": [k.tobytes() for k in kept]})
        return pd.concat((met, saved), ignore_index=True)

    return run


def _meet_rest(kept: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """All candidate pairs of the wanted classes and words in a part."""
    rows = np.frombuffer(b"".join(kept["data"]), _ENTRY)
    rows = rows[np.isin(rows["token"], wanted["token"].to_numpy(np.int64))]
    x, y, _ = candidates(rows, wanted["ka"].to_numpy(np.int64).view(np.uint64))
    return _pair_rows(x, y)


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted word hashes of wanted lines."""
    for frame in frames:
        texts, ids, row_hashes = row_texts(frame), row_ids(frame), frame["row"].to_numpy(np.int64)
        wanted = frame["wanted"].tolist()
        for a, b in chunks(texts):
            hashes, line, doc, number = line_words(texts[a:b])
            h, starts, at = line_sets(hashes, line, np.zeros(len(hashes), np.uint8))
            ends = np.append(starts[1:], len(h))
            ask = [set(map(int, w)) for w in wanted[a:b]]
            take = [i for i in range(len(starts)) if int(number[at[i]]) in ask[doc[at[i]]]]
            if take:
                ka, kb, _ = identities(h, starts)
                yield pd.DataFrame({
                    "doc": ids[a:b][doc[at[take]]], "row": row_hashes[a:b][doc[at[take]]], "line": number[at[take]],
                    "ka": ka[take].view(np.int64), "kb": kb[take].view(np.int64),
                    "words": [np.sort(h[starts[i] : ends[i]]).tobytes() for i in take],
                })


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        good = np.zeros(len(frame), bool)
        for i, (x, y) in enumerate(zip(frame["words"], frame["ewords"])):
            p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(p, q, assume_unique=True))
            good[i] = common * DENOMINATOR >= NUMERATOR * (len(p) + len(q) - common)
        yield frame.loc[good, _PLACE]


def _distinct(pairs: DataFrame) -> DataFrame:
    """A pair comes once from each part in which it met; within a part it is distinct already."""
    return pairs.repartition(*_ENDS).distinct()


def _matched(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """First lines (``doc``, ``row``, ``line``) of classes that truly match their earlier partner."""
    ends = pairs.select(_PLACE).union(pairs.select("edoc", "erow", "eline")).distinct()
    wanted = materialize(ends.groupBy("doc", "row").agg(F.collect_list("line").alias("wanted")))
    wanted = broadcast_if_few(wanted, F.size("wanted") + 1)
    texts = docs.select(document_id().alias("doc"), text_hash().alias("row"), "text").join(wanted, ["doc", "row"])
    texts = texts.select(F.col("doc").alias("doc_id"), "row", "text", "wanted")
    sets = materialize(texts.mapInPandas(_sets, "doc long, row long, line long, ka long, kb long, words binary"))
    sets = sets.dropDuplicates([*_PLACE, "ka", "kb"])
    early = sets.select(*[F.col(c).alias("e" + c) for c in (*_PLACE, "words")], F.col("ka").alias("ea"), F.col("kb").alias("eb"))
    both = (
        pairs.join(sets, [*_PLACE, "ka", "kb"]).join(early, ["edoc", "erow", "eline", "ea", "eb"])
        .select(*_PLACE, "words", "ewords")
    )
    return both.mapInPandas(_verify, "doc long, row long, line long").distinct()


def lost_lines(docs: DataFrame) -> DataFrame:
    """``doc``, ``row``, ``lost``: the numbers of the lines that go, of documents that lose some."""
    cells, _ = total_sketch(bound_batches(docs).select("text").mapInPandas(_count, "cell int, n long"))
    words = int(cells[:WIDTH].sum())
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / 4 / PART_ENTRIES))
    texts = docs.select(document_id().alias("doc_id"), text_hash().alias("row"), "text")
    packed = texts.mapInPandas(_entries(cells, parts), "part long, data binary")
    met = materialize(packed.groupBy("part").applyInPandas(_meet(parts), _MET))
    pairs = materialize(_distinct(met.where(F.col("kind") == PAIR).select(_ENDS)))
    matched = materialize(_matched(docs, pairs))
    more = met.where(F.col("kind") == MORE).select("part", "token", "ka", *_PLACE)
    rest = materialize(more.join(matched, _PLACE, "left_anti").select("part", "token", "ka"))
    if rest.take(1):
        kept = met.where(F.col("kind") == KEPT).select("part", "data")
        pairs = kept.groupBy("part").cogroup(rest.groupBy("part")).applyInPandas(_meet_rest, _PAIR)
        matched = matched.union(_matched(docs, materialize(_distinct(pairs))))
    gone = met.where(F.col("kind") == COPY).select(_PLACE).union(matched.select(_PLACE))
    # Rows hardly repeat within a task, so they are dealt first and gathered once, in few tasks.
    return gone.repartition("doc", "row").groupBy("doc", "row").agg(F.collect_set(F.col("line").cast("int")).alias("lost"))


def _rebuild(lost_name: str):
    """Takes the lost lines out; texts that lose none are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lost, text = batch.column(names.index(lost_name)), batch.column(names.index("text"))
            where = np.flatnonzero(pc.is_valid(lost).to_numpy(zero_copy_only=False))
            lines = pc.if_else(pc.equal(pc.binary_length(text), 0), 0, pc.add(pc.count_substring(text, "\n"), 1))
            gone = np.zeros(len(batch), np.int64)
            if len(where):
                mask, new = np.zeros(len(batch), bool), []
                mask[where] = True
                for t, numbers in zip(text.take(where).to_pylist(), lost.take(where).to_pylist()):
                    numbers, whole = set(numbers), (t or "").split("\n")
                    kept = [x for k, x in enumerate(whole) if k not in numbers]
                    gone[where[len(new)]] = len(whole) - len(kept)
                    new.append(None if t is None else "\n".join(kept))
                text = pc.replace_with_mask(text, mask, pa.array(new, text.type))
            columns = {name: batch.column(k) for k, name in enumerate(names) if name != lost_name}
            columns |= {"text": text, "n_lines": pc.fill_null(lines, 0).cast(pa.int64()), "n_removed": pa.array(gone)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows with later matching lines taken out of ``text``; adds ``n_lines`` and ``n_removed``, or replaces such columns."""
    own, own_row, lost_name = free_name(docs, "own_id"), free_name(docs, "own_row"), free_name(docs, "lost_lines")
    lost = materialize(lost_lines(docs).select(F.col("doc").alias(own), F.col("row").alias(own_row), F.col("lost").alias(lost_name)))
    lost = broadcast_if_few(lost, F.size(lost_name) + 1)
    joined = docs.withColumns({own: document_id(), own_row: text_hash()}).join(lost, [own, own_row], "left").drop(own, own_row)
    kept = [f for f in docs.schema if f.name not in ("n_lines", "n_removed")]
    schema = StructType([*kept, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return joined.select(*[f.name for f in kept], lost_name).mapInArrow(_rebuild(lost_name), schema)


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """Documents without later matching lines, in the same columns; those that lose every line with a word are dropped."""
    words = F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")
    extra = {n: free_name(docs, n + "_before") for n in ("n_lines", "n_removed") if n in docs.columns}
    kept = dedup_lines(docs.withColumnsRenamed(extra)).where((F.col("n_removed") == 0) | words).drop("n_lines", "n_removed")
    return kept.withColumnsRenamed({v: k for k, v in extra.items()}).select(*docs.columns)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without its later matching lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
