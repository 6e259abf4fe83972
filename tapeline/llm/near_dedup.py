"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is the weighted set of its five-word shingles. The weight is the shingle's count in the
document times its inverse document frequency: 1 plus the mean, over its five words, of
``ln((1 + N) / (1 + df)) / ln(1 + N)``. Word document frequencies cover all documents, in a count-min
sketch of fixed size, since the shingles of a corpus are almost all distinct.

1. Documents with the same shingle counts form one text; later steps see one row per text.
2. ``BANDS * ROWS`` ICWS samples agree between two texts with the probability of their weighted
   Jaccard similarity. Texts that agree in a whole band meet in a bucket.
3. Each bucket has a hub, and a text is compared with the smallest of its buckets' hubs first. Where a bucket still holds
   different groups, its members are compared with its hub, then those in different groups with up to
   ``HUBS`` hubs, then all that are left in different groups with each other. A large group of near
   copies so costs about one comparison per member, and no pair that could join two groups is skipped.
4. A comparison is exact: weighted Jaccard similarity of at least 0.8 of the whole texts. Members of a
   hub are dealt out over tasks in portions of ``PORTION``. Of what is left, buckets of over ``SMALL``
   members are compared in blocks: two cells of members go to one task, which bounds all their
   similarities by matrix products, checks what the bound leaves, and returns links only.
5. Groups are connected components, by pointers to the smallest neighbour and contraction in Spark.

Defined results: NULL and empty texts are alone in their group; texts without words
are grouped with exact copies only; a text of
fewer than five words is one shingle; NULL ``doc_id`` counts as the smallest number; rows
of one ``doc_id`` are told apart and ordered by a hash of their text; the group is named after its
first row (``doc_id``, then hash), and that row stays; of rows equal in both one stays. Texts of
any length are read whole; an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import NO_ID, WIDTH, bound_batches, broadcast_if_few, document_id, free_name, row_ids, row_texts, sketch_slots, text_hash, total_sketch
from tapeline.llm.words import SHINGLE, chunks, doc_words, mix, shingles
from tapeline.session import materialize

THRESHOLD = 0.8
BANDS, ROWS = 10, 3
HUBS = 8
PORTION = 256
SMALL, CELL = 64, 512

_LOG = -np.log((np.arange(65536) + 0.5) / 65536).astype(np.float32)
_HALF = np.uint64(0xFFFF)


def _sorted_by_doc(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (document, hash), and which places begin a new pair of them."""
    key = (doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    order = np.argsort(key)
    h, k = hashes[order], key[order]
    same = k[1:] == k[:-1]
    if (len(doc) and doc[-1] >= 1 << 20) or (same & (h[1:] != h[:-1])).any():
        order = np.lexsort((hashes, doc))
        h = hashes[order]
        same = (h[1:] == h[:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, np.concatenate(([True], ~same))[: len(order)]


def _document_frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sketch cells of words by document; cell -1 counts the documents."""
    cells, rows = np.zeros(2 * WIDTH, np.int64), 0
    for frame in frames:
        texts = row_texts(frame)
        rows += len(texts)
        for a, b in chunks(texts):
            words, offsets = doc_words(texts[a:b])
            doc = np.repeat(np.arange(b - a), np.diff(offsets))
            order, fresh = _sorted_by_doc(words, doc)
            for slot in sketch_slots(words[order][fresh]):
                cells += np.bincount(slot, minlength=2 * WIDTH)
    used = np.flatnonzero(cells)
    yield pd.DataFrame({"cell": np.append(used, -1), "n": np.append(cells[used], rows)})


class Weights:
    """Weighted shingles of texts under the corpus' document frequencies."""

    def __init__(self, cells: np.ndarray, documents: int):
        self.idf = (np.log((1.0 + documents) / (1.0 + np.minimum(cells, documents))) / np.log(1.0 + max(documents, 1))).astype(np.float32)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text in hash order, their weights, and the texts' offsets; then counts."""
        words, offsets = doc_words(texts)
        found, at = shingles(words, offsets)
        one, two = sketch_slots(words)
        rarity = np.maximum(self.idf[one], self.idf[two])  # the smaller count is the better estimate
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        begin = offsets[doc] + np.arange(len(found)) - at[doc]
        end = np.minimum(begin + SHINGLE, offsets[doc + 1])
        order, fresh = _sorted_by_doc(found, doc)
        heads = np.flatnonzero(fresh)
        count = np.diff(np.append(heads, len(order)))
        pick = order[heads]
        begin, end = begin[pick], end[pick]
        total = np.zeros(len(pick), np.float32)
        for k in range(SHINGLE):
            total += np.where(begin + k < end, rarity[np.minimum(begin + k, end - 1)], np.float32(0))
        idf = 1.0 + total / np.maximum(end - begin, 1)
        return found[pick], (count * idf).astype(np.float32), np.searchsorted(doc[pick], np.arange(len(texts) + 1)), count


def text_keys(ids: np.ndarray, count: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the counted shingles of each text; 0 for none."""
    keys = []
    for salt in (3, 5):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(ids + np.uint64(salt)) * count.astype(np.uint64), dtype=np.uint64)))
        keys.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return keys[0], keys[1]


def samples(ids: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ICWS samples, one row per text (all with shingles) and ``BANDS * ROWS`` columns."""
    starts, size = offsets[:-1], np.diff(offsets)
    logs = np.log(weights)
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        z = (ids + np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        r = _LOG[z & _HALF] + _LOG[(z >> np.uint64(16)) & _HALF]
        beta = ((z >> np.uint64(32)) & _HALF).astype(np.float32) * np.float32(1 / 65536)
        z *= np.uint64(0x94D049BB133111EB)
        c = _LOG[z >> np.uint64(48)] + _LOG[(z >> np.uint64(32)) & _HALF]
        t = np.floor(logs / r + beta)
        a = np.log(c) - r * (t - beta + np.float32(1))
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), size))
        first = least[np.searchsorted(least, starts)]
        out[:, k] = mix(ids[first] + t[first].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """One key per band."""
    out = np.empty((len(drawn), BANDS), np.int64)
    for band in range(BANDS):
        key = np.full(len(drawn), np.uint64(band))
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + drawn[:, k])
        out[:, band] = key.view(np.int64)
    return out


def _signatures(weights: Weights):
    """A row per document, with bands on the first of each text in a chunk only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, doc_ids, row_hashes = row_texts(frame), row_ids(frame), frame["row"].to_numpy(np.int64)
            for a, b in chunks(texts):
                ids, w, offsets, count = weights.sets(texts[a:b])
                ka, kb = text_keys(ids, count, offsets)
                size = np.diff(offsets)
                grouped = size > 0
                for i in np.flatnonzero(~grouped):
                    if t := texts[a + i]:  # no words: named by the whole text
                        ka[i], kb[i] = np.frombuffer(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "<i8")
                        grouped[i] = True
                fresh = np.zeros(b - a, bool)
                fresh[np.unique(np.stack([ka, kb]), axis=1, return_index=True)[1]] = True
                fresh &= size > 0
                keep = np.repeat(fresh, size)
                sums = np.concatenate(([0.0], np.cumsum(w, dtype=np.float64)))
                signed: list = [None] * (b - a)
                if fresh.any():
                    own = np.concatenate(([0], np.cumsum(size[fresh])))
                    for i, row in zip(np.flatnonzero(fresh), bands(samples(ids[keep], w[keep], own))):
                        signed[i] = row
                yield pd.DataFrame({
                    "doc": doc_ids[a:b], "row": row_hashes[a:b], "ka": ka, "kb": kb, "grouped": grouped,
                    "weight": sums[offsets[1:]] - sums[offsets[:-1]], "bands": signed,
                })

    return run


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    p, q = x[1].astype(np.float64), y[1].astype(np.float64)
    common = np.minimum(p[i], q[j]).sum()
    total = p.sum() + q.sum() - common
    return float(common / total) if total else 0.0


def _compare(weights: Weights):
    """Rows come sorted: a hub (``member`` -1), then its members."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, hub_set = None, None
        for frame in frames:
            texts, hubs, members = frame["text"].tolist(), frame["hub"].tolist(), frame["member"].tolist()
            good: list[tuple[int, int]] = []
            for a, b in chunks(texts):
                ids, w, offsets, _ = weights.sets(texts[a:b])
                for i in range(a, b):
                    own = slice(offsets[i - a], offsets[i - a + 1])
                    if members[i] < 0:
                        hub, hub_set = hubs[i], (ids[own], w[own])
                    elif hub == hubs[i] and similarity(hub_set, (ids[own], w[own])) >= THRESHOLD:
                        good.append((hubs[i], members[i]))
            yield pd.DataFrame(good, columns=["a", "b"])

    return run


def _verified(texts: DataFrame, pairs: DataFrame, weights: Weights) -> DataFrame:
    """Those of ``pairs`` (hub, member) that are similar; ``texts`` has ``text_id`` and ``text``."""
    portion = F.pmod(F.xxhash64("member"), F.ceil(F.coalesce("n", F.lit(1)) / PORTION).cast("long"))
    # Hubs of more than a portion, few beside the pairs.
    sizes = broadcast_if_few(materialize(pairs.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > PORTION)), F.lit(2))
    dealt = materialize(pairs.join(sizes, "hub", "left").select("hub", "member", portion.alias("portion")))
    heads = dealt.select("hub", "portion").distinct().withColumn("member", F.lit(-1).cast("long"))
    rows = (
        dealt.join(texts, F.col("member") == F.col("text_id"))
        .select("hub", "portion", "member", "text")
        .union(heads.join(texts, F.col("hub") == F.col("text_id")).select("hub", "portion", "member", "text"))
    )
    sorted_rows = rows.repartition("hub", "portion").sortWithinPartitions("hub", "portion", "member")
    return materialize(sorted_rows.mapInPandas(_compare(weights), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``text_id`` and ``label`` (the smallest number reached) of every end of ``edges`` (a, b).

    Each round every number points to its smallest neighbour, if that is smaller, and pointers are followed to their ends.
    The edges are then drawn between these ends only, without loops and repeats, so that their table shrinks from round to round.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found = None
    while left.take(1):
        ends = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        points = materialize(ends.select(F.col("a").alias("text_id"), F.least("a", "b").alias("label")))
        while True:
            # Two steps at a time: pointers seldom run further, and every look costs a job.
            twice = points.join(points.select(F.col("text_id").alias("label"), F.col("label").alias("further")), "label")
            twice = twice.select("text_id", F.col("further").alias("label"))
            jump = twice.select(F.col("text_id").alias("label"), F.col("label").alias("further"))
            step = materialize(twice.join(jump, "label").select("text_id", F.col("further").alias("label"), (F.col("further") < F.col("label")).alias("moved")))
            points = step.select("text_id", "label")
            if not step.where("moved").take(1):
                break
        for end in ("a", "b"):
            left = left.join(points.select(F.col("text_id").alias(end), F.col("label").alias(f"{end}_label")), end)
        left = left.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        left = materialize(left.where("a < b").distinct())
        if found is None:
            found = points
        else:
            later = points.select(F.col("text_id").alias("label"), F.col("label").alias("later"))
            found = materialize(found.join(later, "label", "left").select("text_id", F.coalesce("later", "label").alias("label")))
    return edges.sparkSession.createDataFrame([], "text_id long, label long") if found is None else found


def _bucket_pairs(buckets: DataFrame, hubs: int | None) -> DataFrame:
    """Pairs (hub, member) of one bucket in different groups whose weights allow the similarity."""
    one = buckets.select("band", F.col("text_id").alias("hub"), F.col("label").alias("hub_label"), F.col("weight").alias("hub_weight"))
    if hubs is not None:
        slot = F.pmod(F.xxhash64("text_id"), F.lit(hubs))
        chosen = buckets.groupBy("band", slot.alias("slot")).agg(F.min(F.struct("text_id", "label", "weight")).alias("h"))
        one = chosen.select("band", F.col("h.text_id").alias("hub"), F.col("h.label").alias("hub_label"), F.col("h.weight").alias("hub_weight"))
    close = F.least("weight", "hub_weight") >= THRESHOLD * F.greatest("weight", "hub_weight") * (1 - 1e-6)
    ordered = F.col("hub") < F.col("text_id") if hubs is None else F.col("hub") != F.col("text_id")
    met = buckets.join(one, "band").where(ordered & (F.col("label") != F.col("hub_label")) & close)
    return met.select("hub", F.col("text_id").alias("member")).distinct()


def _elected_pairs(buckets: DataFrame) -> DataFrame:
    """One pair for each text, with the smallest of the hubs of its buckets."""
    return _bucket_pairs(buckets, 1).groupBy("member").agg(F.min("hub").alias("hub")).select("hub", "member")


def _block_links(weights: Weights):
    """Links between the members of two cells of a bucket (of one cell, if they are the same)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, labels, cells = (frame[c].to_numpy() for c in ("text_id", "label", "cell"))
        texts, n = frame["text"].tolist(), len(frame)
        sets = []
        for a, b in chunks(texts):
            ids, w, offsets, _ = weights.sets(texts[a:b])
            sets += [(ids[offsets[i] : offsets[i + 1]], w[offsets[i] : offsets[i + 1]]) for i in range(b - a)]
        totals = np.array([w.sum(dtype=np.float64) for _, w in sets])
        ids = np.concatenate([x for x, _ in sets])
        owner = np.repeat(np.arange(n), [len(x) for x, _ in sets])
        root = np.sqrt(np.concatenate([w for _, w in sets]))
        order = np.argsort(ids, kind="stable")
        column = np.cumsum(np.concatenate(([0], ids[order][1:] != ids[order][:-1])))
        common = np.zeros((n, n), np.float32)  # at least the sum of the smaller weights
        for low in range(0, int(column[-1]) + 1, 2048):
            a, b = np.searchsorted(column, (low, low + 2048))
            part = np.zeros((n, 2048), np.float32)
            part[owner[order[a:b]], column[a:b] - low] = root[order[a:b]]
            common += part @ part.T
        both = totals[:, None] + totals[None, :]
        able = (common * (1 + 1e-4) >= THRESHOLD / (1 + THRESHOLD) * both) & (labels[:, None] != labels[None, :])
        if (cells != cells[0]).any():
            able &= cells[:, None] != cells[None, :]
        group = {x: x for x in set(labels.tolist())}

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        links = []
        for i, j in zip(*np.nonzero(np.triu(able, 1))):
            p, q = find(labels[i]), find(labels[j])
            if p != q and similarity(sets[i], sets[j]) >= THRESHOLD:
                group[p] = q
                links.append((numbers[i], numbers[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _large_links(contents: DataFrame, buckets: DataFrame, weights: Weights) -> DataFrame:
    """Links of large buckets, all pairs of cells compared; ``n`` is the size of a row's bucket."""
    parts = F.ceil(F.col("n") / CELL).cast("long")
    dealt = buckets.select("band", "text_id", "label", parts.alias("parts"), F.pmod(F.xxhash64("text_id"), parts).alias("cell"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("*", other).withColumn("low", F.least("cell", "other")).withColumn("high", F.greatest("cell", "other"))
    rows = dealt.join(contents, "text_id").select("band", "low", "high", "cell", "text_id", "label", "text")
    return rows.groupBy("band", "low", "high").applyInPandas(_block_links(weights), "a long, b long")


def _links(docs: DataFrame, signed: DataFrame, weights: Weights) -> tuple[DataFrame, DataFrame]:
    """Texts (``text_id``, ``ka``, ``kb``, ``first``: ``doc`` and ``row``) and the labels of those that have a near copy."""
    texts = signed.where("grouped").groupBy("ka", "kb").agg(F.min(F.struct("doc", "row")).alias("first"), F.first("weight").alias("weight"), F.first("bands", True).alias("bands"))
    number = F.shiftrightunsigned(F.xxhash64("ka", "kb"), 1)
    texts = materialize(texts.withColumn("text_id", number))
    members = texts.select("text_id", "weight", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialize(members.join(shared, "band"))
    wanted = members.select("text_id").distinct().join(texts.select("text_id", "first.doc", "first.row"), "text_id")
    wanted = broadcast_if_few(materialize(wanted), F.lit(3))
    contents = docs.select(document_id().alias("doc"), text_hash().alias("row"), "text").join(wanted, ["doc", "row"]).select("text_id", "text")
    contents = materialize(contents.dropDuplicates(["text_id"]))
    edges = tested = labels = None
    for hubs in (0, 1, HUBS, None):
        if labels is None:
            buckets = members.withColumn("label", F.col("text_id"))
        else:
            buckets = members.join(labels, "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
            mixed = buckets.groupBy("band").agg((F.min("label") != F.max("label")).alias("mixed"), F.count("*").alias("n")).where("mixed").select("band", "n")
            buckets = materialize(buckets.join(mixed, "band"))
            if hubs is None:
                large = buckets.where(F.col("n") > SMALL)
                if large.take(1):
                    edges = edges.union(materialize(_large_links(contents, large, weights)))
                    labels = components(edges)
                buckets = buckets.where(F.col("n") <= SMALL)
        pairs = _elected_pairs(buckets) if hubs == 0 else _bucket_pairs(buckets, hubs)
        if tested is not None:
            both = tested.union(tested.select("member", "hub"))
            pairs = pairs.join(both, ["hub", "member"], "left_anti")
        pairs = materialize(pairs)
        if not pairs.take(1):
            continue
        found = _verified(contents, pairs, weights)
        tested = pairs if tested is None else tested.union(pairs)
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "text_id long, label long")
    return texts.select("text_id", "ka", "kb", "first"), labels


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc``, ``row``, ``class`` and ``class_row`` (those of the group's first row) of every row."""
    counted = bound_batches(docs).select("text").mapInPandas(_document_frequencies, "cell int, n long")
    cells, documents = total_sketch(counted)
    weights = Weights(cells, documents)
    signed = materialize(docs.select(document_id().alias("doc_id"), text_hash().alias("row"), "text").mapInPandas(
        _signatures(weights), "doc long, row long, ka long, kb long, grouped boolean, weight double, bands array<long>"
    ))
    texts, labels = _links(docs, signed, weights)
    named = texts.join(labels, "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    named = materialize(named.join(least, "label").select("ka", "kb", "least"))
    own = [F.when(F.col("grouped"), F.col(f"least.{c}")).otherwise(F.col(c)).alias(n) for c, n in (("doc", "class"), ("row", "class_row"))]
    return signed.select("doc", "row", "ka", "kb", "grouped").join(named, ["ka", "kb"], "left").select("doc", "row", *own)


def _is_first() -> F.Column:
    return (F.col("doc") == F.col("class")) & (F.col("row") == F.col("class_row"))


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id``, ``class_key`` and ``is_kept`` of every row.

    ``class_id`` is the ``doc_id`` of the group's first row; that may be NULL or repeated, so ``class_key``, the hash of its
    text, completes the name. ``is_kept`` marks the first row, and any that equal it in id and text.
    """
    back = [F.when(F.col(c) != NO_ID, F.col(c)).alias(name) for c, name in (("doc", "doc_id"), ("class", "class_id"))]
    return _grouped(docs).select(*back, F.col("class_row").alias("class_key"), _is_first().alias("is_kept"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each group, its first row by ``doc_id`` and hash of the text."""
    own, own_row, times = free_name(docs, "own_id"), free_name(docs, "own_row"), free_name(docs, "times")
    kept = _grouped(docs).where(_is_first()).groupBy(F.col("doc").alias(own), F.col("row").alias(own_row)).agg(F.count("*").alias(times))
    kept = materialize(kept)
    repeated = kept.where(F.col(times) > 1).take(1)
    kept = broadcast_if_few(kept, F.lit(3))
    out = docs.withColumns({own: document_id(), own_row: text_hash()}).join(kept, [own, own_row])
    if repeated:
        # Of rows equal in id and text one stays.
        several = out.where(F.col(times) > 1).dropDuplicates([own, "text"])
        out = out.where(F.col(times) == 1).unionByName(several)
    return out.select(*docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document of ``documents``."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "is_kept", "class_key")
