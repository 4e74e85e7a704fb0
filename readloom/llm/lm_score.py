"""Cross-entropy difference of two matched n-gram models (Moore-Lewis selection).

Target documents train one bigram model, all others the background. Both are
matched: one vocabulary (the distinct words of all documents, A-Z lower-cased), one
unigram model of all documents that both fall back on, one prior, and one evidence:
counts of the larger side are scaled to the tokens of the smaller, so that a score
does not depend on how much larger the background is. A document's own counts are
left out of the model that it trained, so nothing is scored by itself.

    p(w | c) = (scale * n(c, w) + prior * q(w)) / (scale * n(c, .) + prior)

n leaves the document's own counts out, q(w) = (n(w) + 1) / (tokens + words + 1).
A document's score is the mean over its tokens of the target loss less the
background loss, in nats: low is close to the target.

Counts are exact, by 64-bit hashes of words and contexts, and grow with the corpus.
One shuffle brings all occurrences of a word together, as packed arrays of about
``BUCKET`` pairs, where sums over groups give pair, word and context counts at once;
the losses go back summed by document, packed too. The ``heavy`` most frequent words are
known to every task: pairs of two of them are counted in arrays of fixed size and never
shuffled, pairs of one of them are dealt by the pair. So no key has more rows than the next
most frequent word, 1 / ``heavy`` of all at most; a task holds one bucket with it. Words are
dealt into ``parts`` parts, one after the other, which bounds the disk of the shuffle.

Defined cases: texts without words (null and empty ones) have 0 tokens and null
losses; a document counts as target once however many target rows name it, null ids
name none; without documents of one side that model is the shared unigram model;
each of repeated rows trains the models and leaves out its own counts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import hashing as H
from readloom.llm.common import release, whole_groups, written

PRIOR = 50.0  # tokens of evidence that the shared unigram model stands for
HEAVY = 512
PARTS = 2
BUCKET = 1 << 19  # pairs that are brought together at once
_HOLD = 1 << 20  # words, pairs or documents that a task gathers before it sends them


class Corpus(NamedTuple):
    """What every task knows; of a size that ``heavy`` bounds."""

    words: np.ndarray  # sorted hashes of the heavy words
    total: np.ndarray  # their occurrences
    after: np.ndarray  # 2 x (heavy + 1): how often each was a context, by model; last the beginnings of texts
    pairs: np.ndarray  # 2 x (heavy + 1) * heavy: pairs of two heavy words by model
    scale: tuple[float, float]
    mass: float  # tokens + words + 1
    prior: float


class _Step(NamedTuple):
    h: np.ndarray  # words
    text: np.ndarray  # number of each word's text in the step
    before: np.ndarray  # its context, 0 where a text begins
    head: np.ndarray
    followed: np.ndarray  # whether it is a context itself


def _step(w: H.Words) -> _Step:
    h = H.word_hashes(w)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    full = w.first[:-1] < w.first[1:]
    head, followed = np.zeros(len(h), bool), np.ones(len(h), bool)
    head[w.first[:-1][full]] = True
    followed[w.first[1:][full] - 1] = False
    before = np.zeros(len(h), H.U64)
    before[1:] = h[:-1]
    before[head] = 0
    return _Step(h, text, before, head, followed)


def _hits(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(bool)


def _sums(key: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    u, at = np.unique(key, return_inverse=True)
    return u, [np.bincount(at, c, len(u)).astype(np.int64) for c in counts]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns w, t, b (occurrences by model), ta, ba (as context); w is 0 for the beginnings."""
    held: list[tuple] = []

    def rows() -> pa.RecordBatch:
        u, sums = _sums(np.concatenate([x[0] for x in held]), [np.concatenate(c) for c in zip(*[x[1] for x in held], strict=True)])
        return pa.record_batch([pa.array(H.signed(u)), *map(pa.array, sums)], ["w", "t", "b", "ta", "ba"])

    for b in batches:
        hit = _hits(b.column(1))
        for w in H.steps(b.column(0), lower=True):
            s = _step(w)
            if not len(s.h):
                continue
            mine = hit[w.lo + s.text]
            n = int(s.head.sum())
            key = np.concatenate([s.h, np.zeros(n, H.U64)])
            begun, none = mine[s.head], np.zeros(n, bool)
            held.append(_sums(key, [np.append(mine, none), np.append(~mine, none), np.append(mine & s.followed, begun), np.append(~mine & s.followed, ~begun)]))
            if sum(len(x[0]) for x in held) > _HOLD:
                yield rows()
                held = []
    if held:
        yield rows()


def _places(words: np.ndarray, s: _Step) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word, and of its context, among the heavy ones; -1: not heavy."""
    if not len(words):
        return np.full(len(s.h), -1), np.where(s.head, 0, -1)
    at = np.minimum(np.searchsorted(words, s.h), len(words) - 1)
    j = np.where(words[at] == s.h, at, -1)
    c = np.full(len(j), -1)
    c[1:] = j[:-1]
    c[s.head] = len(words)
    return j, c


def _count_pairs(words: np.ndarray):
    """Columns f (pair of heavy words), t, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (len(words) + 1) * len(words)
        total = np.zeros((2, size), np.int64)
        for b in batches:
            hit = _hits(b.column(1))
            for w in H.steps(b.column(0), lower=True):
                s = _step(w)
                j, c = _places(words, s)
                both = (j >= 0) & (c >= 0)
                flat, mine = c[both] * len(words) + j[both], hit[w.lo + s.text[both]]
                total[0] += np.bincount(flat[mine], minlength=size)
                total[1] += np.bincount(flat[~mine], minlength=size)
        at = np.flatnonzero(total.any(0))
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[0, part]), pa.array(total[1, part])], ["f", "t", "b"])

    return run


def _distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, counts and inverse of the distinct (text, key)."""
    _, at, inverse, n = np.unique(H.mix(key + H._P * (text.astype(H.U64) + H.U64(1))), return_index=True, return_inverse=True, return_counts=True)
    return at, n, inverse


def _near(corpus: Corpus):
    """Of each row what heavy words decide: n_tokens, losses lt and lb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = corpus, len(corpus.words)
        for b in batches:
            hit = _hits(b.column(1))
            for w in H.steps(b.column(0), lower=True):
                s = _step(w)
                texts = len(w.first) - 1
                n = np.diff(w.first)
                own = np.stack([hit[w.lo : w.lo + texts], ~hit[w.lo : w.lo + texts]])
                j, c = _places(m.words, s)
                both = np.flatnonzero((j >= 0) & (c >= 0))
                at, times, _ = _distinct(s.text[both], (c[both] * max(k, 1) + j[both]).astype(H.U64))
                pair = both[at]
                ctx = np.flatnonzero((j >= 0) & s.followed)
                at, used, _ = _distinct(s.text[ctx], j[ctx].astype(H.U64))
                ctx = ctx[at]
                q = m.prior * (m.total[j[pair]] + 1) / m.mass
                loss = []
                for one in range(2):
                    scale = m.scale[one]
                    top = scale * (m.pairs[one, c[pair] * k + j[pair]] - times * own[one, s.text[pair]]) + q
                    low = scale * (m.after[one, j[ctx]] - used * own[one, s.text[ctx]]) + m.prior
                    begin = np.log(scale * (m.after[one, k] - own[one]) + m.prior) * (n > 0)
                    loss.append(begin + np.bincount(s.text[ctx], used * np.log(low), texts) - np.bincount(s.text[pair], times * np.log(top), texts))
                rest = [b.column(i).slice(w.lo, texts) for i in range(2, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), *map(pa.array, loss)], names=["id", "k", "n_tokens", "lt", "lb"])

    return run


_CELL = "b int, heavy boolean, g binary, c binary, n binary, a binary, k binary, hit binary, run binary"
_SUMS = "b int, k binary, lt binary, lb binary"


def _cells(bucket: np.ndarray, cols: list[np.ndarray], order: np.ndarray | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """The buckets that occur, and of each column the packed values of each bucket."""
    order = np.argsort(bucket, kind="stable") if order is None else order
    at = bucket[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    bounds, out = np.append(first, len(at)), []
    for x in cols:
        raw = np.ascontiguousarray(x[order])
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw)]))
    return at[first], out


def _far(corpus: Corpus, part: int, parts: int, buckets: int):
    """Distinct pairs of each text that are not of two heavy words, packed by bucket; rows of
    heavy words apart. g: word, or pair if the word is heavy; c: context, or the heavy word's
    number; n: times; a: times that a light word is a context, at one row of each word; k,
    hit, run: numbers of the rows, their sides and how many pairs are theirs, one after the other."""

    def rows(held: list[tuple], heavy: bool) -> pa.RecordBatch:
        g, c, n, a, k, hit = [np.concatenate(x) for x in zip(*held, strict=True)]
        bucket = (H.mix(g + H._P) % H.U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at, cells = _cells(bucket, [g, c, n] if heavy else [g, c, n, a], order)
        if heavy:
            cells.append(pa.array([b""] * len(at), pa.binary()))
        new = np.ones(len(g), bool)
        new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (k[order][1:] != k[order][:-1])
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(g))).astype(np.uint32)
        row = order[first]
        _, who = _cells(bucket[row], [k[row], hit[row], run], np.arange(len(row)))
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), heavy)), *cells, *who], names=["b", "heavy", "g", "c", "n", "a", "k", "hit", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = [0, 0]
        for b in batches:
            hit, key = _hits(b.column(1)), b.column(2).to_numpy()
            for w in H.steps(b.column(0), lower=True):
                s = _step(w)
                j, c = _places(corpus.words, s)
                heavy = j >= 0
                pick = ~(heavy & (c >= 0))
                if parts > 1:
                    pick &= (H.mix(s.h + H._Q) % H.U64(parts)) == part
                pick = np.flatnonzero(pick)
                pair = H.mix(s.before[pick] * H._Q + s.h[pick])
                at, times, inverse = _distinct(s.text[pick], pair)
                row = pick[at]
                used = np.zeros(len(row), np.uint32)
                light = np.flatnonzero(~heavy[pick])
                first, _, word = _distinct(s.text[pick[light]], s.h[pick[light]])
                used[inverse[light[first]]] = np.bincount(word, s.followed[pick[light]], len(first)).astype(np.uint32)
                # In the order of the texts, so that a row's number is sent once a bucket.
                back = np.argsort(row)
                row, at, times, used = row[back], at[back], times[back].astype(np.uint32), used[back]
                text = w.lo + s.text[row]
                ctx = np.where(c[row] >= 0, (c[row] + 1).astype(H.U64), s.before[row])
                for kind, of in enumerate((~heavy[row], heavy[row])):
                    if of.any():
                        names = (pair[at[of]], j[row[of]].astype(np.uint32), times[of], used[:0]) if kind else (s.h[row[of]], ctx[of], times[of], used[of])
                        held[kind].append((*names, key[text[of]], hit[text[of]]))
                        size[kind] += int(of.sum())
                    if size[kind] > _HOLD:
                        yield rows(held[kind], bool(kind))
                        held[kind].clear()
                        size[kind] = 0
        for kind in range(2):
            if held[kind]:
                yield rows(held[kind], bool(kind))

    return run


def _numbers(col: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind)


def _bucket_losses(corpus: Corpus, buckets: int):
    """Losses of each bucket (rows sorted by b and heavy), summed by row number and packed again."""

    def one(heavy: bool, cells: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds = (H.U64, np.uint32 if heavy else H.U64, np.uint32, np.uint32, np.int64, np.bool_, np.uint32)
        g, c, n, a, k, hit, run = [_numbers(x, kind) for x, kind in zip(cells, kinds, strict=True)]
        mine = np.repeat(hit, run)
        word, w = np.unique(g, return_inverse=True)
        if heavy:
            pair, q = w, corpus.total[c] + 1.0
        else:
            # Contexts are told apart among the rows of a word only.
            pair = np.unique(H.mix(c * H._Q + H.mix(g)), return_inverse=True)[1]
            q = np.bincount(w, n)[w] + 1
        q *= corpus.prior / corpus.mass
        owner, loss = np.repeat(np.arange(len(k)), run), []
        for scale, own in zip(corpus.scale, (mine, ~mine), strict=True):
            times = n * own
            term = n * np.log(scale * (np.bincount(pair, times)[pair] - times) + q)
            if not heavy:
                used = a * own
                term -= a * np.log(scale * (np.bincount(w, used)[w] - used) + corpus.prior)
            loss.append(np.bincount(owner, -term, len(k)))
        return k, *loss

    def summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return k, *[np.bincount(at, np.concatenate([x[i] for x in held]), len(k)) for i in (1, 2)]

    def packed(k: np.ndarray, lt: np.ndarray, lb: np.ndarray) -> pa.RecordBatch:
        b, cells = _cells((H.mix(k.view(H.U64)) % H.U64(buckets)).astype(np.int32), [k, lt, lb])
        return pa.RecordBatch.from_arrays([pa.array(b), *cells], names=["b", "k", "lt", "lb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, cells = [], None, []
        for b in batches:
            for i in range(len(b)):
                key = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if key != at and cells:
                    held.append(one(at[1], list(zip(*cells, strict=True))))
                    cells = []
                    if sum(len(x[0]) for x in held) > _HOLD:
                        held = [summed(held)]
                        if len(held[0][0]) > _HOLD // 2:
                            yield packed(*held[0])
                            held = []
                at = key
                cells.append([b.column(j)[i].as_py() for j in range(2, 9)])
        if cells:
            held.append(one(at[1], list(zip(*cells, strict=True))))
        if held:
            yield packed(*summed(held))
        H.tidy()

    return run


def _sum_losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by row number (rows sorted by b)."""
    for b in whole_groups(batches):
        at = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            k, lt, lb = [_numbers(b.column(i).slice(lo, hi - lo).to_pylist(), kind) for i, kind in ((1, np.int64), (2, float), (3, float))]
            names, place = np.unique(k, return_inverse=True)
            yield pa.record_batch([pa.array(names), *[pa.array(np.bincount(place, x, len(names))) for x in (lt, lb)]], ["k", "lt", "lb"])


def _read_corpus(rows: DataFrame, heavy: int, prior: float) -> Corpus:
    words = written(rows.select("text", "hit").mapInArrow(_count_words, "w long, t long, b long, ta long, ba long").groupBy("w").agg(*[F.sum(x).alias(x) for x in ("t", "b", "ta", "ba")]), "words")
    size, t, b = words.filter("w != 0").agg(F.count("*"), F.sum("t"), F.sum("b")).first()
    begun = words.filter("w = 0").select("ta", "ba").first() or (0, 0)
    # ``heavy`` rows at most.
    top = sorted((r["w"] & (2**64 - 1), *r[1:]) for r in words.filter("w != 0").orderBy(F.expr("t + b").desc(), "w").limit(heavy).collect())
    release(words)
    table = np.array([x[1:] for x in top], np.int64).reshape(-1, 4)
    hashes = np.array([x[0] for x in top], H.U64)
    after = np.append(table[:, 2:].T, np.array(begun, np.int64).reshape(2, 1), axis=1)
    pairs = np.zeros((2, (len(top) + 1) * len(top)), np.int64)
    if top:
        got = rows.select("text", "hit").mapInArrow(_count_pairs(hashes), "f int, t long, b long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
        pairs[:, got["f"].to_numpy()] = got["t"].to_numpy(), got["b"].to_numpy()
    sides = [t or 0, b or 0]
    least = min([x for x in sides if x], default=0)
    return Corpus(hashes, table[:, :2].sum(1), after, pairs, tuple(least / x if x else 0.0 for x in sides), float(sum(sides) + size + 1), prior)


def _losses(rows: DataFrame, corpus: Corpus, part: int, parts: int, bucket: int) -> DataFrame:
    """(k, lt, lb) by row, over the pairs of one part."""
    buckets = int(corpus.mass) // (parts * bucket) + 1
    pairs = rows.select("text", "hit", "k").mapInArrow(_far(corpus, part, parts, buckets), _CELL).repartition("b").sortWithinPartitions("b", "heavy")
    sums = pairs.mapInArrow(_bucket_losses(corpus, buckets), _SUMS).repartition("b").sortWithinPartitions("b")
    return sums.mapInArrow(_sum_losses, "k long, lt double, lb double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, heavy: int = HEAVY, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score), a row for each document.

    ``targets`` has the ids of target documents in its column ``id_col``.
    """
    named = targets.select(F.col(id_col).alias("tid")).distinct().withColumn("hit", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # A merge join at every size: texts move once, whatever the size of the target list.
    rows = rows.join(named.hint("merge"), rows["id"] == named["tid"], "left").select("id", "text", F.coalesce("hit", F.lit(False)).alias("hit"))
    rows = written(rows.withColumn("k", F.monotonically_increasing_id()), "sides")
    corpus = _read_corpus(rows, heavy, prior)
    far = [written(_losses(rows, corpus, part, parts, bucket), "losses") for part in range(parts)]
    far = reduce(DataFrame.unionByName, far).groupBy(F.col("k").alias("fk")).agg(F.sum("lt").alias("ft"), F.sum("lb").alias("fb"))
    near = rows.select("text", "hit", "id", "k").mapInArrow(_near(corpus), f"id {rows.schema['id'].dataType.simpleString()}, k long, n_tokens long, lt double, lb double")
    out = near.join(far, near["k"] == far["fk"], "left")
    t, b = [F.when(F.col("n_tokens") > 0, (F.col(f"l{x}") + F.coalesce(f"f{x}", F.lit(0.0))) / F.col("n_tokens")) for x in "tb"]
    return out.select("id", "n_tokens", t.alias("target_loss"), b.alias("background_loss"), (t - b).alias("score"))
