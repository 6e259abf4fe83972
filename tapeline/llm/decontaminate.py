"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

The index is inverted: terms with postings (item, impact), the items in blocks of ``BLOCK`` with like
self-scores. Items of like length, up to the same power of two of words, share an index; for it a document is cut
into segments of that many words, and two neighbouring segments form a passage, so that an item lies whole in some
passage, and its passages depend on its own length only. Search is
block-max WAND over sets of terms: a term's largest impact in a block bounds what it can add
there; a (passage, block) pair whose bounds stay under the block's threshold is skipped, the
others are scored in full. All items with at least ``RETRIEVE`` of their own greatest score are
retrieved, and verified: a leak holds ``OVERLAP`` of the five-word shingles that start in the
question and of those that touch the answer (the last sentence), or ``WHOLE`` of all of them.

Only the index, at most ``SHARD_ITEMS * SHARDS_AT_ONCE`` items, is sent to the tasks; a larger
benchmark takes further passes over the documents. Documents are never shuffled. What is told of an item does not
depend on the other items, but for the document frequencies that weigh its terms.

Defined results: NULL and empty texts, of documents and items, never match; an item shorter than
five words is one shingle; repeated items count once, repeated documents each; a document
reports each item once, with the best passage. Documents of any length are searched whole; an empty table on either side gives
no leaks; other columns are ignored whatever their names, and pass through where documents are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bound_batches, filter_texts
from tapeline.llm.words import SHINGLE, chunks, doc_words, mix, shingles
from tapeline.session import materialize

K1, B = 1.2, 0.75
BLOCK = 16
RETRIEVE = 0.5
OVERLAP, WHOLE = 0.5, 0.8
SHARD_ITEMS = 512
SHARDS_AT_ONCE = 4

_SENTENCE = re.compile(r"(?:[.!?]+\s+|\n\s*)(?=\S)")


def answer_start(text: str) -> int:
    """The number of words before the last sentence; 0 if there is but one."""
    ends = [m.end() for m in _SENTENCE.finditer(text.strip())]
    return len(doc_words([text.strip()[: ends[-1]]])[0]) if ends else 0


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per item and term; ids stay Arrow values, so that NULL beside large numbers does no harm."""
    for batch in batches:
        places, columns = [], {"text": [], "length": [], "step": [], "term": [], "tf": []}
        for place, text in enumerate(batch.column(1).to_pylist()):
            words = doc_words([text])[0]
            terms, tf = np.unique(words, return_counts=True)
            places += [place] * len(terms)
            columns["text"] += [text] * len(terms)
            columns["length"] += [len(words)] * len(terms)
            columns["step"] += [step_of(len(words))] * len(terms)
            columns["term"] += terms.view(np.int64).tolist()
            columns["tf"] += tf.tolist()
        kinds = {"text": pa.string(), "length": pa.int32(), "step": pa.int32(), "term": pa.int64(), "tf": pa.int32()}
        made = {c: pa.array(values, kinds[c]) for c, values in columns.items()}
        yield pa.RecordBatch.from_pydict({"item": batch.column(0).take(pa.array(places, pa.int64())), **made})


def step_of(length: int) -> int:
    """The power of two that is the segment length for items of so many words."""
    return max(0, length - 1).bit_length()


class Index:
    """One shard, of items with one stride: sorted terms, dense impacts by item, block maxima and thresholds, item shingles."""

    def __init__(self, postings: pd.DataFrame, step: int, items: int, mean_length: float):
        texts = postings.drop_duplicates(["item", "text"]).reset_index(drop=True)
        self.items = texts["item"].to_numpy()
        place = {pair: i for i, pair in enumerate(zip(texts["item"], texts["text"]))}
        row = np.array([place[p] for p in zip(postings["item"], postings["text"])], int)
        term = postings["term"].to_numpy(np.int64).view(np.uint64)
        self.terms, column = np.unique(term, return_inverse=True)
        df, tf = postings["df"].to_numpy(float), postings["tf"].to_numpy(float)
        idf = np.log(1 + (items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * postings["length"].to_numpy(float) / mean_length)
        impact = np.zeros((len(self.terms), len(texts)), np.float32)
        impact[column, row] = idf * tf * (K1 + 1) / (tf + norm)
        order = np.argsort(impact.sum(0), kind="stable")
        self.items, texts, self.impact = self.items[order], texts.iloc[order], impact[:, order]
        starts = np.arange(0, len(order), BLOCK)
        self.starts = starts
        self.impact = np.ascontiguousarray(self.impact.T)
        self.bounds = np.maximum.reduceat(self.impact, starts, axis=0)
        self.own = self.impact.sum(1)
        self.need = RETRIEVE * self.own[starts]
        self.stride = 1 << step
        self.width, self.shingles, self.answers = [], [], []
        for text in texts["text"]:
            words, offsets = doc_words([text])
            self.width.append(min(SHINGLE, len(words)))
            self.shingles.append(shingles(words, offsets)[0] if len(words) >= SHINGLE else _runs(words, len(words)))
            self.answers.append(answer_start(text))
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their term numbers."""
        at = np.flatnonzero(self.near[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        good = self.terms[number] == words[at]
        return at[good], number[good]

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Shares of the question's, of the answer's and of all shingles found among a passage's words."""
        width, own, answer = self.width[item], self.shingles[item], self.answers[item]
        there = np.isin(own, _runs(words, width))
        first = np.arange(len(own))
        question = there[first < answer] if answer else there
        whole = float(there.mean())
        return float(question.mean()) if len(question) else 1.0, float(there[first + width > answer].mean()), whole

    def _passages(self, impacts: np.ndarray, begins: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Sums over each segment and the one that follows it in the same document."""
        sums = np.add.reduceat(impacts, begins)
        sums[:-1] += np.where(follows[:-1], sums[1:], 0)
        return sums

    def search(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """Leaks (document, item, score, overlaps of question, answer and whole) in a batch of documents."""
        at, number = self.lookup(words)
        if not len(at):
            return []
        doc = np.searchsorted(offsets, at, side="right") - 1
        per_doc = -(-np.diff(offsets) // self.stride)
        first = np.concatenate(([0], np.cumsum(per_doc)))
        segment = first[doc] + (at - offsets[doc]) // self.stride
        pair = np.unique(segment * len(self.terms) + number)
        segment, number = pair // len(self.terms), pair % len(self.terms)
        begins = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        used = segment[begins]
        ends = np.append(begins[1:], len(segment))
        owner = np.searchsorted(first, used, side="right") - 1
        follows = np.zeros(len(used), bool)
        follows[:-1] = (used[1:] == used[:-1] + 1) & (owner[1:] == owner[:-1])
        place = np.repeat(np.arange(len(used)), ends - begins)
        best: dict[tuple[int, int], tuple[float, float, float, float, float]] = {}
        for block, start in enumerate(self.starts):
            live = np.flatnonzero(self._passages(self.bounds[block][number], begins, follows) >= self.need[block])
            if not len(live):
                continue
            # What the bound leaves is added up for each item of the block; a term in both segments counts twice here.
            asked = np.zeros(len(used) + 1, bool)
            asked[live] = True
            asked[live + 1] |= follows[live]
            asked = asked[:-1]
            terms, size = number[asked[place]], (ends - begins)[asked]
            heads = np.cumsum(size) - size
            sums = np.zeros(len(used), np.float32)
            for i in range(start, min(start + BLOCK, len(self.own))):
                sums[asked] = np.add.reduceat(self.impact[i][terms], heads)
                both = sums + np.append(np.where(follows[:-1], sums[1:], 0), 0)
                for s in live[both[live] >= RETRIEVE * self.own[i]]:
                    distinct = np.unique(number[begins[s] : ends[s + 1] if follows[s] else ends[s]])
                    score = float(self.impact[i][distinct].sum())
                    if score < RETRIEVE * self.own[i]:
                        continue
                    d = int(owner[s])
                    a = offsets[d] + (used[s] - first[d]) * self.stride
                    question, answer, whole = self.overlaps(i, words[a : min(a + 2 * self.stride, offsets[d + 1])])
                    if min(question, answer) >= OVERLAP or whole >= WHOLE:
                        found = (question + answer, score, question, answer, whole)
                        if (d, i) not in best or found > best[d, i]:
                            best[d, i] = found
        return [(d, i, *found[1:]) for (d, i), found in best.items()]


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, equal to ``shingles`` for full ones."""
    if len(words) < width or not width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k]
    return mix(total)


def indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The index, in groups of shards that hold at most ``SHARD_ITEMS * SHARDS_AT_ONCE`` items together."""
    kind = dict(benchmark.dtypes)["item_id"]
    items = benchmark.select(F.col("item_id").alias("item"), "text").where(F.length(F.trim("text")) > 0).dropDuplicates()
    terms = materialize(items.mapInArrow(_terms, f"item {kind}, text string, length int, step int, term long, tf int"))
    sizes = terms.select("item", "text", "length").distinct().agg(F.count("*"), F.avg("length")).first()
    if not sizes[0]:
        return
    # One count for each power of two.
    counts = {r["step"]: r["n"] for r in terms.select("item", "text", "step").distinct().groupBy("step").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, math.ceil(n / SHARD_ITEMS))]), F.col("step"))
    postings = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term")
    postings = postings.withColumn("part", F.pmod(F.xxhash64("item", "text"), parts).cast("int"))
    wait: list[tuple[int, int]] = []
    room = SHARD_ITEMS * SHARDS_AT_ONCE
    for s, n in sorted(counts.items()):
        for part in range(math.ceil(n / SHARD_ITEMS)):
            own = min(n, SHARD_ITEMS)
            if wait and own > room:
                yield _shards(postings, wait, sizes)
                wait, room = [], SHARD_ITEMS * SHARDS_AT_ONCE
            wait.append((s, part))
            room -= own
    yield _shards(postings, wait, sizes)


def _shards(postings: DataFrame, wanted: list[tuple[int, int]], sizes: tuple) -> list[Index]:
    chosen = F.lit(False)
    for step, part in wanted:
        chosen = chosen | ((F.col("step") == step) & (F.col("part") == part))
    rows = postings.where(chosen).toArrow().to_pandas(integer_object_nulls=True).sort_values(["item", "text", "term"])
    return [Index(own, int(step), sizes[0], float(sizes[1])) for (step, _), own in rows.groupby(["step", "part"])]


def _found(group: list[Index], texts: list[str | None]) -> Iterator[tuple[int, Index, tuple]]:
    for a, b in chunks(texts):
        words, offsets = doc_words(texts[a:b])
        for index in group:
            for hit in index.search(words, offsets):
                yield a + hit[0], index, hit


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item."""
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, score double, question_overlap double, answer_overlap double, whole_overlap double"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    for group in indexes(benchmark):
        def run(batches: Iterator[pa.RecordBatch], group: list[Index] = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.items[i], *rest) for d, index, (_, i, *rest) in _found(group, batch.column(1).to_pylist())]
                if rows:
                    first, *others = (list(column) for column in zip(*rows))
                    yield pa.RecordBatch.from_pydict(dict(zip(names, [pa.array(first, pa.int64()), *map(pa.array, others)])))

        out = out.unionByName(bound_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; judged in place, without a join."""
    for group in indexes(benchmark):
        def keep(texts: list[str | None], group: list[Index] = group) -> np.ndarray:
            good = np.ones(len(texts), bool)
            good[[d for d, _, _ in _found(group, texts)]] = False
            return good

        docs = filter_texts(docs, keep)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The items of ``benchmark`` that each document of ``documents`` holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
