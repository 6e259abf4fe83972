"""Language identification by error-correcting output codes (ECOC) over hashed n-grams.

Every language gets a codeword; one binary n-gram classifier per bit tells the languages
with a 1 from those with a 0. A text goes to the language whose codeword has the smallest
loss, each bit weighted by how reliable it was for that language on labelled rows; a text with
two codewords almost equally near is flagged ambiguous.

* Training counts are one distributed sum over at most ``fit_rows`` labelled rows (chosen by
  a hash of the key); the driver sees ``languages x DIM`` sums, never texts.
* Prediction is one pass without a shuffle.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0; with no
labelled row at all every text is ``und``; with one language every text with a letter gets
it. Ties go to the alphabetically first language. Other columns are never read;
an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bound_batches, filter_texts, map_texts
from tapeline.llm.words import chunks

DIM = 1 << 14
ORDERS = (1, 2, 3, 4)
FIT_ROWS = 20_000
AMBIGUOUS = 0.005
MAX_LANGUAGES = 512
UNKNOWN = "und"

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """One document in five is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits per language: all splits for few languages, else distant random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, float).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > gap:
            best, gap = code, apart
    return best


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of the byte n-grams of each order, and where each text begins and ends."""
    parts = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts) + bytes(max(ORDERS)), np.uint8).astype(np.uint32)
    bounds = np.cumsum([0] + [len(p) for p in parts])
    n, out = int(bounds[-1]), []
    code = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        code = (code << np.uint32(8)) | raw[order - 1 : order - 1 + n]
        if order in ORDERS:
            h = (code + np.uint32(order)) * np.uint32(0x9E3779B1)
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(18))
    return out, bounds


@dataclass
class LanguageModel:
    """Weights per bucket and bit, codewords, and the weight of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Mean log odds of each bit, squashed to -1..1."""
        buckets, bounds = grams(texts)
        out = np.zeros((len(texts), self.weights.shape[1]))
        for bit in range(self.weights.shape[1]):
            column = np.ascontiguousarray(self.weights[:, bit])
            total = np.zeros(int(bounds[-1]), np.float32)
            for b in buckets:
                total += column[b]
            out[:, bit] = np.add.reduceat(total, bounds[:-1], dtype=np.float64) if len(texts) else 0
        return np.tanh(2.0 * out / np.diff(bounds)[:, None])

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its probability-like score and the gap to the next."""
        losses = np.exp(-margins[:, None, :] * self.code[None]) * self.trust[None]
        loss = losses.sum(2)
        best = loss.argmin(1)
        spread = np.exp(-8.0 * (loss - loss.min(1, keepdims=True)))
        ordered = np.sort(loss, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1.0 / spread.sum(1), gap


def _count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, group in frame.groupby("lang"):
            texts = group["text"].tolist()
            into = sums.setdefault(lang, np.zeros(DIM))
            for a, b in chunks(texts):
                for bucket in grams(texts[a:b])[0]:
                    into += np.bincount(bucket, minlength=DIM)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at].astype(np.int64)})


def _hits(model: LanguageModel):
    place = {name: i for i, name in enumerate(model.languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, rows = np.zeros(model.code.shape), np.zeros(len(place))
        for frame in frames:
            texts, own = frame["text"].tolist(), frame["lang"].map(place).to_numpy()
            for a, b in chunks(texts):
                good = model.margins(texts[a:b]) * model.code[own[a:b]] > 0
                np.add.at(right, own[a:b], good)
                np.add.at(rows, own[a:b], 1)
        i, j = np.indices(right.shape)
        yield pd.DataFrame({"lang": i.ravel(), "bit": j.ravel(), "good": right.ravel(), "n": np.repeat(rows, right.shape[1])})

    return count


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of rows outside the held-out fifth; about ``fit_rows`` of them."""
    labelled = bound_batches(docs).where(~held_out()).where("lang IS NOT NULL").where("text IS NOT NULL")
    total = labelled.count()
    every = max(1, total // fit_rows)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text", "lang")
    counts = (
        sample.mapInPandas(_count_grams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(counts["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES}")
    table = np.full((len(languages), DIM), 0.5)
    if languages:
        table[counts["lang"].map({v: i for i, v in enumerate(languages)}), counts["bucket"]] += counts["n"]
    share = table / table.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((DIM, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        on, off = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(on) and len(off):
            weights[:, bit] = np.log(on.mean(0)) - np.log(off.mean(0))
    model = LanguageModel(languages, code, weights, np.full(code.shape, 1.0 / max(1, code.shape[1])))
    if len(languages) > 1:
        seen = (
            sample.mapInPandas(_hits(model), "lang int, bit int, good double, n double")
            .groupBy("lang", "bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toPandas()
        )
        trust = np.zeros(code.shape)
        trust[seen["lang"], seen["bit"]] = (seen["good"] + 1) / (seen["n"] + 2)
        model.trust = trust / trust.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: LanguageModel, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` for every row; reads ``text`` only."""
    names = np.array([*model.languages, UNKNOWN], object)

    def label(texts: list[str | None]) -> dict:
        best, score, gap = _told(model, texts)
        known = best >= 0
        return {
            "lang_pred": names[best].tolist(), "score": np.where(known, score, 0.0), "ambiguous": known & (gap < ambiguous),
        }

    return map_texts(docs, label, "lang_pred string, score double, ambiguous boolean")


def _told(model: LanguageModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number (-1 for none), score and gap of each text."""
    best, score, gap = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    for a, b in chunks(texts) if model.languages else ():
        part = texts[a:b]
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in part])
        own, score[a:b], gap[a:b] = model.decode(model.margins(part))
        best[a:b] = np.where(known, own, -1)
    return best, score, gap


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known; those that are ``und`` or ambiguous go.

    Whole rows pass, also repeated and NULL ``doc_id``: the rows are judged in place, without a join.
    """
    model = fit(docs)

    def keep(texts: list[str | None]) -> np.ndarray:
        best, _, gap = _told(model, texts)
        return (best >= 0) & (gap >= AMBIGUOUS)

    return filter_texts(docs, keep)
