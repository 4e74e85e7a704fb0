"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary naive Bayes classifier over
hashed byte n-grams tells the languages whose bit is set from the others. A text
gets from each classifier the evidence of all its n-grams; loss-weighted decoding
takes the codeword of least logistic loss and flags the text as ambiguous if the
next one is close.

Fitting reads a sample of labelled documents of bounded expected size
(``max_docs`` of each language, chosen by a hash of the id). Tasks count n-grams
in arrays of fixed size; the model has ``buckets`` rows and one column a bit.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as
is every text if no language could be learned; with one language every other text
is of that one. A null id is held out. Prediction sees nothing but the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import hashing as H

BUCKETS = 1 << 15
ORDERS = (2, 4)
MAX_DOCS = 2000
AMBIGUOUS = 0.1  # least distance between the two best scores
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)  # bytes that are no letters become blanks
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of distinct bits far from each other: every split of up to 5
    languages, else the best of several random codes of 12 bits a doubling."""
    if n <= 1:
        return np.zeros((n, 1), bool)
    if n <= 5:
        return np.array([[(c >> i) & 1 for c in range(1, 1 << (n - 1))] for i in range(n)], bool)
    rng = np.random.Generator(np.random.PCG64(seed))
    bits = math.ceil(12 * math.log2(n))

    def apart(c: np.ndarray) -> int:
        d = (c[:, None] != c[None]).sum(-1) + bits * np.eye(n, dtype=int)
        return int(d.min())

    return max((rng.random((n, bits)) < 0.5 for _ in range(50)), key=apart)


def _grams(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and where the texts' begin. A gram that
    runs over a text's end counts for that text with blanks in place."""
    fold = _FOLD[data]
    n = len(fold)
    text_end = np.repeat(offsets[1:], np.diff(offsets))
    x = fold.astype(np.uint32)
    for j in range(1, order):
        nxt = np.full(n, 32, np.uint32)
        nxt[: n - j] = fold[j:]
        nxt[np.arange(n) + j >= text_end] = 32
        x = x * np.uint32(0x01000193) + nxt
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((x >> np.uint32(13)) % np.uint32(buckets)).astype(np.int64), offsets


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +-1
    weights: np.ndarray  # (orders * buckets) x bits

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of the languages, a row for each text."""
        out = np.zeros((len(texts), len(self.languages)))
        bits = self.code.shape[1]
        buckets = len(self.weights) // len(ORDERS)
        for w in H.steps(texts, step_bytes=1 << 18):
            k = len(w.offsets) - 1
            sums = np.zeros((k, bits))
            full = np.flatnonzero(np.diff(w.offsets))
            if len(full):
                for j, order in enumerate(ORDERS):
                    g, begin = _grams(w.data, w.offsets, order, buckets)
                    sums[full] += np.add.reduceat(self.weights[j * buckets + g], begin[:-1][full], axis=0)
            # Evidence grows with length but not without bound: long texts repeat themselves.
            evidence = 12 * sums / (np.abs(sums) + 60 + 0.05 * np.diff(w.offsets)[:, None])
            loss = np.logaddexp(0, -evidence[:, None, :] * self.code[None]).sum(-1)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            out[w.lo : w.lo + k] = p / p.sum(1, keepdims=True)
        return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _count(languages: list[str], buckets: int):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), len(ORDERS) * buckets), np.int64)
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for w in H.steps(b.column(0), step_bytes=1 << 18):
                who = np.repeat(lang[w.lo : w.lo + len(w.offsets) - 1], np.diff(w.offsets))
                for j, order in enumerate(ORDERS):
                    g, _ = _grams(w.data, w.offsets, order, buckets)
                    flat = np.bincount(who * buckets + g, minlength=len(languages) * buckets)
                    total[:, j * buckets : (j + 1) * buckets] += flat.reshape(len(languages), buckets)
        a, f = np.nonzero(total)
        if len(a):
            yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[a, f])], ["l", "f", "n"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, buckets: int = BUCKETS) -> Model:
    """Learns from the documents that are not held out and have a language."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # One row a language; text is not read here.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    code = codewords(len(languages))
    weights = np.zeros((len(ORDERS) * buckets, code.shape[1]), np.float32)
    if languages:
        chance = F.element_at(F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, max_docs / sizes[x]))]), F.col("lang"))
        u = F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 11).cast("double") / F.lit(float(1 << 53))
        counts = rows.filter(u < chance).select("text", "lang").mapInArrow(_count(languages, buckets), "l int, f int, n long")
        c = np.zeros((len(languages), len(ORDERS) * buckets))
        got = counts.groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow()  # at most languages * orders * buckets rows
        c[got["l"].to_numpy(), got["f"].to_numpy()] = got["n"].to_numpy()
        for j in range(len(ORDERS)):
            part = c[:, j * buckets : (j + 1) * buckets]
            p = (part + 0.5) / (part + 0.5).sum(1, keepdims=True)  # of each language alike, whatever its share
            for bit in range(code.shape[1]):
                one, zero = code[:, bit], ~code[:, bit]
                if one.any() and zero.any():
                    weights[j * buckets : (j + 1) * buckets, bit] = np.log(p[one].mean(0)) - np.log(p[zero].mean(0))
    return Model(languages, np.where(code, 1.0, -1.0), weights)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, ambiguous) and the columns ``keep``, a row for each document.

    A kept column whose name is taken gets underscores at its end. Of languages
    with equal scores the first by name is predicted, and the text is ambiguous.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # of fixed size
    names = ["id", "lang_pred", "score", "ambiguous"]
    for c in (*[c for c in keep if c not in (id_col, text_col)], *[text_col] * (text_col in keep)):
        while c in names:
            c += "_"
        names.append(c)
    extra = [c for c in keep if c not in (id_col, text_col)]
    texts = text_col in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.slice(lo, 500)
                n = len(b)
                some = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                pred, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
                if m.languages:
                    p = m.scores(b.column(1))
                    best = p.argmax(1)
                    top = np.sort(p, axis=1)
                    gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)
                    pred = np.where(some, np.array(m.languages, object)[best], UNKNOWN)
                    score = np.where(some, np.clip(top[:, -1], 0, 1), 0.0)
                    unsure = some & (gap < AMBIGUOUS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(unsure), *b.columns[3:], *[b.column(1)] * texts], names=["id", "lang_pred", "score", "ambiguous", *[f"c{i}" for i in range(len(extra))], *["text"] * texts])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), letters.alias("some"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(extra)])
    kinds = [f"id {dict(docs.dtypes)[id_col]}", "lang_pred string", "score double", "ambiguous boolean", *[f"c{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(extra)], *["text string"] * texts]
    out = rows.mapInArrow(run, ", ".join(kinds))
    return out.toDF(*names)
