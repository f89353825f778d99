"""Quality classifier: supervised subword embeddings.

A document's features are its words, the 3- to 5-byte n-grams of ``<word>``
and its word pairs, hashed into ``BUCKETS`` learned vectors.  A word's vector
is the mean of its word and n-gram vectors; the document's is the mean over
its words and word pairs; a linear layer and a softmax give the class
probabilities.  A pair of equal words hashes to one feature of its own, so
stuttering text is recognised whatever the word.

Training is stochastic gradient descent in numpy on a bounded sample of the
labelled rows (``MAX_TRAIN``, lowest key hashes first), whose sparse feature
vectors are made by the executors from whole texts.  Scoring is a map over all
documents.  As the average and the output layer are linear, each bucket's
vector is multiplied by the output layer once, before scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import is_bounded
from ..operators.lineage import cut
from .common import col, fold, map_batches, text_or_empty, with_computed, words

BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4, 5)
MAX_TRAIN = 3_000            # labelled rows learned from, at most
VISITS = 24_000              # documents visited by gradient descent in all
RATE = 0.4                   # first learning rate, falling linearly to 0
CHUNK_BYTES = 1 << 20        # text handled at a time while scoring
REPEATED = np.uint64(0x5851F42D4C957F2D)

_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return ((h >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _P)]).astype(np.uint64))


_POW = _powers(256)


def word_features(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash of each word, owner, bucket)``: the buckets of every distinct word and its n-grams."""
    buf = np.frombuffer(b"".join(b"<" + w + b">" for w in vocab), np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in vocab], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(vocab)), size)
    pos = np.arange(len(buf)) - begin[owner]
    whole = np.add.reduceat(buf * _POW[pos % 256] * (pos // 256 + 1).astype(np.uint64), begin)
    left = size[owner] - pos
    owners, buckets = [np.arange(len(vocab))], [_bucket(whole)]
    for n in GRAMS:
        if len(buf) < n:
            continue
        h = np.zeros(len(buf) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * _P + buf[k:len(buf) - n + 1 + k]
        ok = left[:len(h)] >= n
        owners.append(owner[:len(h)][ok])
        buckets.append(_bucket(h[ok] * np.uint64(2 * n + 1)))
    return whole, np.concatenate(owners), np.concatenate(buckets)


def pair_buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _MIX + (right ^ (right >> np.uint64(29)))
    return _bucket(np.where(left == right, REPEATED, h))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse averaged feature vector of one text: buckets and their weights (summing to 1)."""
    w = words(text)
    if not w:
        return np.zeros(0, np.int64), np.zeros(0)
    lut: dict[bytes, int] = {}
    ids = np.array([lut.setdefault(x, len(lut)) for x in w])
    whole, owner, bucket = word_features(list(lut))
    items = 2 * len(w) - 1
    each = np.bincount(ids, minlength=len(lut)) / np.bincount(owner) / items
    h = whole[ids]
    pairs = pair_buckets(h[:-1], h[1:])
    every = np.concatenate([bucket, pairs])
    weight = np.concatenate([each[owner], np.full(len(pairs), 1.0 / items)])
    out, inv = np.unique(every, return_inverse=True)
    return out, np.bincount(inv, weights=weight)


@dataclass
class QualityModel:
    """``gain[bucket]``: log-odds of class 1 a bucket adds; ``bias``: those of an empty text."""

    gain: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 of every text."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_BYTES):
                size += len(texts[stop])
                stop += 1
            out[at:stop] = self._chunk(texts[at:stop])
            at = stop
        return 1.0 / (1.0 + np.exp(-np.clip(out, -60.0, 60.0)))

    def _chunk(self, texts: list[str]) -> np.ndarray:
        split = [words(t) for t in texts]
        n = np.array([len(w) for w in split])
        lut: dict[bytes, int] = {}
        ids = np.array([lut.setdefault(x, len(lut)) for w in split for x in w], dtype=np.int64)
        if not len(ids):
            return np.full(len(texts), self.bias)
        whole, owner, bucket = word_features(list(lut))
        word_gain = np.bincount(owner, weights=self.gain[bucket]) / np.bincount(owner)
        doc = np.repeat(np.arange(len(texts)), n)
        total = np.bincount(doc, weights=word_gain[ids], minlength=len(texts))
        h = whole[ids]
        same = doc[1:] == doc[:-1]
        pair = self.gain[pair_buckets(h[:-1], h[1:])]
        total += np.bincount(doc[1:][same], weights=pair[same], minlength=len(texts))
        return self.bias + total / np.maximum(2 * n - 1, 1)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], visits: int = VISITS, seed: int = 7) -> QualityModel:
    """Gradient descent over the averaged vectors; without samples every score is one half."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    out = np.zeros((DIM, 2))
    bias = np.zeros(2)
    n = len(samples)
    if n:
        share = np.clip(np.mean([y for _, _, y in samples]), 1e-3, 1 - 1e-3)
        bias[:] = 0.0, np.log(share / (1 - share))
    order = np.zeros(0, np.int64)
    for step in range(visits if n else 0):
        if step % n == 0:
            order = rng.permutation(n)
        ids, weight, y = samples[order[step % n]]
        weight = weight.astype(np.float64)
        rate = RATE * (1 - step / visits)
        rows = vectors[ids]
        mean = weight @ rows
        z = mean @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1.0                                     # gradient of the softmax loss
        back = out @ p
        out -= rate * np.outer(mean, p)
        bias -= rate * 0.05 * p
        # weights of one average are tiny; scaling by their length keeps the step size of a word-level update
        vectors[ids] = rows - (rate * weight / max(float(weight @ weight), 1e-12) ** 0.5)[:, None] * back[None, :]
    return QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        learn: Column | None = None, max_train: int = MAX_TRAIN) -> QualityModel:
    """Learn from the labelled rows that pass ``learn`` (a condition on the labels' key).

    Null labels are skipped; a key labelled twice takes its largest label;
    several documents of one key all count, up to ``max_train`` documents in
    all.  The driver receives at most ``max_train`` sparse vectors.
    """
    keyed = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull())
    if learn is not None:
        keyed = keyed.filter(learn)
    pick = (keyed.groupBy(col(id_col).alias("k")).agg(F.max(col(label_col).cast("int")).alias("y"))
            .orderBy(F.xxhash64("k"), "k").limit(max_train))
    texts = df.select(col(id_col).alias("k"), text_or_empty(text_col).alias("t")).join(F.broadcast(pick), "k")

    def features(cols: dict) -> dict:
        got = [document_features(t) for t in cols["t"]]
        return {"k": [str(k) for k in cols["k"]], "y": cols["y"], "ids": [a.astype("<i4").tobytes() for a, _ in got],
                "weight": [b.astype("<f4").tobytes() for _, b in got]}

    rows = cut(map_batches(texts, features, "k string, y int, ids binary, weight binary"), "labelled-features")
    if not is_bounded(rows, max_train):
        rows = rows.orderBy(F.xxhash64("k"), "k", "ids").limit(max_train)
    # two flat arrays, filled a partition at a time
    flat, ends, marks = (bytearray(), bytearray()), [0], []
    for r in rows.filter(F.octet_length("ids") > 0).orderBy("k", "ids").toLocalIterator():
        flat[0].extend(r["ids"])
        flat[1].extend(r["weight"])
        ends.append(len(flat[0]) // 4)
        marks.append(1 if r["y"] > 0 else 0)
    ids, weight = np.frombuffer(flat[0], "<i4"), np.frombuffer(flat[1], "<f4")
    return train([(ids[a:z], weight[a:z], y) for a, z, y in zip(ends, ends[1:], marks)])


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", folds: int = 5, held_out_fold: int = 0, cutoff: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Labels are learned only from keys outside the held-out fold (crc32 of the
    key as text modulo ``folds``).  Null and empty texts get the learned prior;
    null keys are not held out; rows with equal keys are scored one by one;
    without labels every score is 0.5; an empty table gives no row.
    """
    model = fit(df, labels, id_col, text_col, label_col, learn=fold(id_col, folds) != held_out_fold)
    slim = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    src = slim.select("doc_id", text_or_empty("text").alias("t"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "score": shared.value.scores(cols["t"])}

    key = slim.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold("doc_id", folds) == held_out_fold, F.lit(False))
    return map_batches(src, run, f"doc_id {key}, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def keep_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   cutoff: float = 0.3) -> DataFrame:
    """The documents with a score of at least ``cutoff``, with all their columns, whatever their names.

    Null and empty texts get the learned prior; repeated rows stay or go
    together; without labels every score is 0.5; an empty table gives no row.
    """
    model = fit(df, labels, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)          # BUCKETS doubles, whatever the input
    rows, restore = with_computed(df, text_col, lambda texts: {"score": shared.value.scores(texts)}, "score double")
    return restore(rows.filter(F.col("score") >= cutoff))
