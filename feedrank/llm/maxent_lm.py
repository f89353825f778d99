"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

A token is a word (A-Z lower-cased) or the end of a text.  Its probability is
that of its class given the context, times that of the word in its class::

    P(w | h) = softmax_k( b + W[f1(h)] + W[f2(h)] + W[f3(h)] + W[f4(h)] )[class(w)] * c(w) / N(class(w))

The features are hashed into the rows of a table: the previous word, the two
previous words (n-grams), the word before the previous one (a skip), and the
classes of the three previous words.  The table grows with the root of the
training tokens (``table_rows``).  Classes are made from counts: a word's
group is the value of ``group_col`` it is most frequent in (the ``GROUPS - 1``
most frequent values have one each), its band the size of its count.  Words
never seen in training share one class of their own; it is learned by leaving
one out: in training a token's class is that of its count less one.  The
classes' words and the unknown word sum to one for every context.

Every text is turned into tokens once: the first pass writes the numbers of
its words within a part (up to ``PART_TOKENS`` tokens of one task) to a table
that training and scoring read.  Counting is exact and complete and never
gathers the vocabulary in one place: each part's distinct words, hashed to 64
bits, travel packed to the bucket of their hash, are summed there over all
parts, and return to each part that has them as its dictionary, a file in the
shared folder named after the part.  What moves grows with the parts' distinct
words.  Training is one pass of distributed gradient updates: every task takes
AdaGrad steps from the common start, the rows it touched travel to their range
of the table, and each range mixes them, weighted by how often their features
occurred, into a file.  A task learns from at least ``TOKENS_PER_ROW`` tokens
for each row of the table, so what travels stays below a share of the input at
every size.  Scoring is a map, in numpy batches of tokens that touch four rows
of the weights each.  The driver holds the class counts and the bias alone.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import SharedFiles, arrow_schema, col, fold, lower_words, parts, shared_folder, text_bytes, text_or_empty, to_batch

GROUPS, BANDS = 5, 6
CLASSES = GROUPS * BANDS + 1
UNSEEN = CLASSES - 1         # class of words without a count
STEP_TOKENS = 4_096          # tokens of one gradient step
RATE = 0.25                  # AdaGrad learning rate
PART_WORDS = 200_000         # distinct words of a part, and
PART_TOKENS = 4_000_000      # its tokens: the first to be passed ends it
BUCKET_BYTES = 24 << 20      # text bytes per bucket of the counting shuffle
SLICE_BYTES = 1 << 20        # bytes of token numbers learned from or scored at a time
TOKENS_PER_ROW = 64          # tokens a training task learns from, for each row of the table
RANGE_ROWS = 1 << 13         # rows of the table in one range
END_HASH = np.uint64(0x9D5C1F3B7A2E4860)      # stands for the end of a text
START_HASH = np.uint64(0x51ED270B35A4C6D9)    # stands for what comes before a text

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# word hash, training count in the part, group, number in the part
ENTRY = np.dtype([("h", "<u8"), ("c", "<u4"), ("g", "u1"), ("n", "<u4")])
# what a part gets back: training count, group, number in the part
BACK = np.dtype([("c", "<i8"), ("g", "u1"), ("n", "<u4")])
# row of the table, how often its features occurred, the change of its weights times that
CHANGE = np.dtype([("r", "<i8"), ("s", "<f8"), ("w", "<f4", (CLASSES,))])
BIAS = -1                    # the range that stands for the bias
_U = np.uint64


def _hash_words(w: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w), np.uint64, len(w))


def _slot(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    x = (x + _U(salt)) * _A
    x = (x ^ (x >> _U(32))) * _B
    return (x >> _U(64 - bits)).astype(np.int64)


def table_rows(tokens: int) -> int:
    """Rows of the table: the power of two from four times the root of the training tokens on."""
    return 1 << max(12, math.ceil(math.log2(4 * math.sqrt(max(tokens, 1)))))


def classes(count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of words with these training counts and groups (no count: ``UNSEEN``)."""
    band = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) // 2, BANDS - 1)
    return np.where(count > 0, group.astype(np.int64) * BANDS + band, UNSEEN)


# -- counting ------------------------------------------------------------------

class _Numbers(dict):
    """Numbers of words in the order they come; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokenise(docs: DataFrame, kind: str, groups: list[str], buckets: int, folder: str) -> DataFrame:
    """``(pid, id, learn, numbers)`` of every text and ``(pid, bucket, packed)`` of each part's distinct words.

    The hashes of a part's words stay in a file; its name is the attempt's own, so numbers and hashes belong together.
    """
    code = {g: i + 1 for i, g in enumerate(groups)}
    out = f"pid string, id {kind}, learn boolean, numbers binary, bucket int, packed binary"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, pid = SharedFiles(folder), uuid.uuid4().hex
        lut = _Numbers({b"": 0})
        learned: dict[int, list[np.ndarray]] = {}
        tokens = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([[END_HASH], _hash_words(list(lut)[1:])])
            _put(store, f"hashes-{pid}", h.tobytes())
            rows, unseen = [], np.ones(len(h), bool)
            for g, held in learned.items():
                count = np.bincount(np.concatenate(held), minlength=len(h))
                at = np.flatnonzero(count)
                e = np.zeros(len(at), ENTRY)
                e["h"], e["c"], e["g"], e["n"] = h[at], count[at], g, at
                unseen[at] = False
                rows.append(e)
            at = np.flatnonzero(unseen)            # words of texts that are not learned from
            e = np.zeros(len(at), ENTRY)
            e["h"], e["n"] = h[at], at
            every = np.concatenate([*rows, e])
            at = (every["h"] >> _U(20)) % _U(buckets)
            order = np.argsort(at, kind="stable")
            every, at = every[order], at[order].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            n = len(cuts) - 1
            return to_batch({"pid": [pid] * n, "id": [None] * n, "learn": [None] * n, "numbers": [None] * n, "bucket": at[cuts[:-1]],
                             "packed": [every[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]}, schema)

        for b in batches:
            for part in parts(b):
                c = part.to_pydict()
                numbers = []
                for text, learn, group in zip(c["t"], c["learn"], c["grp"]):
                    w = lower_words(text)
                    x = np.zeros(len(w) + 1, np.uint32)
                    x[:-1] = np.fromiter(map(lut.__getitem__, w), np.uint32, len(w))
                    numbers.append(x.tobytes())
                    tokens += len(x)
                    if learn:
                        learned.setdefault(code.get(group, 0), []).append(x)
                n = part.num_rows
                yield to_batch({"pid": [pid] * n, "id": c["id"], "learn": c["learn"], "numbers": numbers, "bucket": [None] * n,
                                "packed": [None] * n}, schema)
                if tokens >= PART_TOKENS or len(lut) >= PART_WORDS:
                    yield flush()
                    pid, lut, tokens = uuid.uuid4().hex, _Numbers({b"": 0}), 0
                    learned.clear()
        if tokens:
            yield flush()

    return docs.mapInArrow(run, out)


def _sum_buckets(words: DataFrame, buckets: int) -> DataFrame:
    """Sum the counts of each bucket over all parts; ``(pid, packed, stats)`` gives every part its words back.

    One more row per bucket, with a null ``pid``, carries the bucket's totals:
    counts per class and distinct trained words.
    """
    out = "pid string, packed binary, stats binary"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pids: list[str] = []
        held: list[np.ndarray] = []
        for b in batches:
            pids += b.column("pid").to_pylist()
            held += [np.frombuffer(x, ENTRY) for x in b.column("packed").to_pylist()]
        if not held:
            return
        every = np.concatenate(held)
        size = np.array([len(x) for x in held])
        del held
        order = np.lexsort((every["g"], every["h"]))
        h, g, c = every["h"][order], every["g"][order], every["c"][order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
        h, g, c = h[new], g[new], np.add.reduceat(c, new)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(c, first)
        # the group a word is most frequent in; the smallest among equals
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        best = np.lexsort((g, -c, word))[first]
        h, g = h[first], g[best]
        k = classes(total, g)
        stats = np.zeros(CLASSES, np.int64)
        np.add.at(stats, k, total)
        yield to_batch({"pid": [None], "packed": [b""],
                        "stats": [pickle.dumps((stats, int((total > 0).sum())))]}, schema)
        at = np.concatenate([[0], np.cumsum(size)])
        by: dict[str, list[int]] = {}
        for i, p in enumerate(pids):
            by.setdefault(p, []).append(i)
        for p, rows in by.items():
            mine = np.concatenate([every[at[i]:at[i + 1]] for i in rows])
            mine = mine[np.unique(mine["n"], return_index=True)[1]]
            where = np.searchsorted(h, mine["h"])
            back = np.zeros(len(mine), BACK)
            back["c"], back["g"], back["n"] = total[where], g[where], mine["n"]
            yield to_batch({"pid": [p], "packed": [back.tobytes()], "stats": [None]}, schema)

    return words.repartition(buckets, "bucket").mapInArrow(run, out)


def _put(store: SharedFiles, name: str, data: bytes) -> None:
    """A file of a known name; every attempt writes the same bytes, and it appears whole."""
    draft, f = store.create(name, ".part")
    f.write(data)
    f.close()
    try:
        store.fs.move(f"{store.root}/{draft}", f"{store.root}/{name}")
    except OSError:                               # stores that do not replace a file
        with store.open(name):
            store.fs.delete_file(f"{store.root}/{draft}")


def _write_dictionaries(rows: DataFrame, tasks: int, folder: str) -> None:
    """One dictionary file per part, in the order of its numbers."""
    out = "pid string"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, last = SharedFiles(folder), [], None

        def write() -> pa.RecordBatch:
            every = np.concatenate(held)
            every = every[np.argsort(every["n"])]
            _put(store, f"words-{last}", every["c"].tobytes() + every["g"].tobytes())
            return to_batch({"pid": [last]}, schema)

        for b in batches:
            for p, x in zip(b.column("pid").to_pylist(), b.column("packed").to_pylist()):
                if p != last and held:
                    yield write()
                    held.clear()
                last = p
                held.append(np.frombuffer(x, BACK))
        if held:
            yield write()

    cut(rows.repartition(tasks, "pid").sortWithinPartitions("pid").mapInArrow(run, out), "dictionaries")


# -- tokens --------------------------------------------------------------------

class _Tokens:
    """Tokens of a batch of texts: hashes, counts, groups and where texts begin."""

    def __init__(self, numbers: list[bytes], known: dict):
        each = [np.frombuffer(x, np.uint32) for x in numbers]
        self.size = np.array([len(x) for x in each])
        self.number = np.concatenate(each)
        self.word_count, self.word_group = known["c"], known["g"]
        self.hash, self.count = known["h"][self.number], self.word_count[self.number]
        self.cls = classes(self.word_count, self.word_group)[self.number]
        self.begin = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.number)) - np.repeat(self.begin, self.size)

    def _before(self, x: np.ndarray, k: int, fill) -> np.ndarray:
        out = np.concatenate([np.full(min(k, len(x)), fill, x.dtype), x[:-k] if k < len(x) else x[:0]])
        out[self.place < k] = fill
        return out

    def features(self, rows: int) -> np.ndarray:
        """Rows of the weights (a table of ``rows``) that each token's context selects."""
        bits = rows.bit_length() - 1
        p1, p2 = (self._before(self.hash, k, START_HASH) for k in (1, 2))
        c1, c2, c3 = (self._before(self.cls, k, CLASSES).astype(np.uint64) for k in (1, 2, 3))
        both = p1 * _A + (p2 ^ (p2 >> _U(31))) * _B
        context = c1 + c2 * _U(64) + c3 * _U(4096)
        return np.stack([_slot(p1, 1, bits), _slot(both, 2, bits), _slot(p2, 3, bits), _slot(context, 4, bits)], axis=1)


class MaxEntModel:
    """Weights ``w`` (rows of the table x CLASSES), bias ``b``, and the corpus totals."""

    def __init__(self, w: np.ndarray, b: np.ndarray, class_count: np.ndarray, distinct: int):
        self.w, self.b, self.class_count, self.distinct = w, b, class_count, distinct
        self.n = int(class_count.sum())

    def class_probabilities(self, f: np.ndarray) -> np.ndarray:
        z = self.w[f[:, 0]]
        for k in range(1, f.shape[1]):
            z += self.w[f[:, k]]
        z += self.b
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def score(self, numbers: list[bytes], known: dict) -> dict:
        """Per text: tokens, known tokens, base score and model score (log10)."""
        t = _Tokens(numbers, known)
        f = t.features(len(self.w))
        log = np.empty(len(t.hash))
        for a in range(0, len(log), STEP_TOKENS):
            p = self.class_probabilities(f[a:a + STEP_TOKENS])
            log[a:a + STEP_TOKENS] = np.log10(np.maximum(p[np.arange(len(p)), t.cls[a:a + STEP_TOKENS]], 1e-30))
        seen = t.count > 0
        log[seen] += np.log10(t.count[seen] / self.class_count[t.cls[seen]])
        base = np.log10((t.word_count + 0.5) / (self.n + 0.5 * (self.distinct + 1)))[t.number]
        return {"n_tokens": t.size, "n_known": np.add.reduceat(seen.astype(np.int64), t.begin),
                "base_score": np.add.reduceat(base, t.begin), "score": np.add.reduceat(log, t.begin)}


class _Trainer:
    """AdaGrad steps of one task from the common start: no weights, and a bias of the classes' shares."""

    def __init__(self, rows: int, bias: np.ndarray):
        none = np.zeros(CLASSES, np.int64)
        self.model = MaxEntModel(np.zeros((rows, CLASSES), np.float32), bias.copy(), none, 0)
        self.start = bias
        self.power = np.full(rows, 1e-3, np.float32)
        self.bias_power = 1e-3
        self.seen = np.zeros(rows)
        self.tokens = 0

    def step(self, f: np.ndarray, target: np.ndarray) -> None:
        m = self.model
        n = len(f)
        err = m.class_probabilities(f)
        np.negative(err, out=err)
        err[np.arange(n), target] += 1.0
        bias = err.mean(axis=0)
        for k in range(f.shape[1]):
            # rows in order, places below them: one sort of whole numbers
            key = np.sort(f[:, k] * STEP_TOKENS + np.arange(n))
            rows = key // STEP_TOKENS
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            g = np.add.reduceat(err[key % STEP_TOKENS], first, axis=0)
            rows, count = rows[first], np.diff(np.append(first, n))
            g /= np.sqrt(count, dtype=np.float32)[:, None]
            power = self.power[rows] + np.einsum("ij,ij->i", g, g)
            self.power[rows] = power
            g *= (np.float32(RATE) / np.sqrt(power))[:, None]
            m.w[rows] += g
            self.seen[rows] += count
        self.bias_power += float((bias * bias).sum())
        m.b += RATE / math.sqrt(self.bias_power) * 0.1 * bias
        self.tokens += n

    def learn(self, numbers: list[bytes], known: dict) -> None:
        t = _Tokens(numbers, known)
        # leave one out: the class the token would have, had it not been seen here
        target = classes(np.maximum(t.word_count - 1, 0), t.word_group)[t.number]
        f = t.features(len(self.seen))
        for a in range(0, len(f), STEP_TOKENS):
            self.step(f[a:a + STEP_TOKENS], target[a:a + STEP_TOKENS])

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """``(range, packed)``: weighted changes of the rows touched, by range of the table, and of the bias."""
        for a in range(0, len(self.seen), RANGE_ROWS):
            rows = a + np.flatnonzero(self.seen[a:a + RANGE_ROWS])
            if len(rows):
                yield a // RANGE_ROWS, _changes(rows, self.seen[rows], self.model.w[rows])
        yield BIAS, _changes(np.array([BIAS]), np.array([self.tokens]), (self.model.b - self.start)[None])


def _changes(rows: np.ndarray, seen: np.ndarray, w: np.ndarray) -> bytes:
    e = np.zeros(len(rows), CHANGE)
    e["r"], e["s"], e["w"] = rows, seen, w * seen[:, None]
    return e.tobytes()


def _by_part(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[dict, dict]]:
    """Columns of slices of rows of one part, and its dictionary."""
    store, pid, known = SharedFiles(folder), None, None
    for b in batches:
        for part in parts(b, SLICE_BYTES):
            c = part.to_pydict()
            cuts = [0, *[i for i in range(1, len(c["pid"])) if c["pid"][i] != c["pid"][i - 1]], len(c["pid"])]
            for x, z in zip(cuts, cuts[1:]):
                if c["pid"][x] != pid:
                    pid = c["pid"][x]
                    with store.open(f"hashes-{pid}") as f:
                        h = np.frombuffer(f.read(), np.uint64)
                    with store.open(f"words-{pid}") as f:
                        words = f.read()
                    known = {"h": h, "c": np.frombuffer(words, np.int64, len(h)), "g": np.frombuffer(words, np.uint8, offset=8 * len(h))}
                yield {k: v[x:z] for k, v in c.items()}, known


def train(tokens: DataFrame, folder: str, rows: int, trained: int, bias: np.ndarray) -> np.ndarray:
    """One pass of gradient updates over all texts to learn from; returns the bias.

    The weights are written as one file for each range of the table that was touched.
    """
    out = "rng int, task int, packed binary"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        t = None
        for c, known in _by_part(batches, folder):
            t = t or _Trainer(rows, bias)
            t.learn(c["numbers"], known)
        for rng, packed in t.changes() if t else ():
            yield to_batch({"rng": [rng], "task": [task], "packed": [packed]}, schema)

    tasks = max(1, trained // (TOKENS_PER_ROW * rows))
    ranges = -(-rows // RANGE_ROWS)
    changes = tokens.filter("learn").select("pid", "numbers").coalesce(tasks).mapInArrow(run, out)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, last, w, seen = SharedFiles(folder), None, None, None

        def done() -> pa.RecordBatch:
            mean = (w / np.maximum(seen, 1.0)[:, None]).astype(np.float32)
            if last != BIAS:
                _put(store, f"weights-{last}", mean.tobytes())
            return to_batch({"rng": [last], "bias": [mean.tobytes() if last == BIAS else None]}, mixed_schema)

        for b in batches:
            for rng, x in zip(b.column("rng").to_pylist(), b.column("packed").to_pylist()):
                if rng != last:
                    if last is not None:
                        yield done()
                    n = 1 if rng == BIAS else min(RANGE_ROWS, rows)
                    last, w, seen = rng, np.zeros((n, CLASSES)), np.zeros(n)
                e = np.frombuffer(x, CHANGE)
                at = e["r"] - (BIAS if rng == BIAS else rng * RANGE_ROWS)
                w[at] += e["w"]
                seen[at] += e["s"]
        if last is not None:
            yield done()

    mixed_schema = arrow_schema("rng int, bias binary")
    mixed = cut(changes.repartition(min(ranges + 1, 1_000), "rng").sortWithinPartitions("rng", "task")
                .mapInArrow(mix, "rng int, bias binary"), "lm-weights")
    change = mixed.filter("bias is not null").select("bias").collect()         # one row
    return bias + np.frombuffer(change[0]["bias"], np.float32) if change else bias


def _read_weights(folder: str, rows: int) -> np.ndarray:
    store = SharedFiles(folder)
    w = np.zeros((rows, CLASSES), np.float32)
    for a in range(0, rows, RANGE_ROWS):
        try:
            f = store.open(f"weights-{a // RANGE_ROWS}")
        except FileNotFoundError:                 # no feature of this range occurred
            continue
        with f:
            part = np.frombuffer(f.read(), np.float32).reshape(-1, CLASSES)
        w[a:a + len(part)] = part
    return w


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang",
                    folds: int = 5, held_out_fold: int = 1) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    The model learns from rows whose key is outside the held-out fold.  Null
    and empty texts are the end token alone; null keys are learned from; null
    or rare groups share one; equal rows count and are scored one by one; if
    nothing is learned from, every token is unseen; an empty table gives no row.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    held = F.coalesce(fold(id_col, folds) == held_out_fold, F.lit(False))
    group = col(group_col).cast("string") if group_col and group_col in df.columns else F.lit(None).cast("string")
    docs = df.select(col(id_col).alias("id"), text_or_empty(text_col).alias("t"), (~held).alias("learn"), group.alias("grp"))
    top = [r["grp"] for r in docs.filter("learn and grp is not null").groupBy("grp").count().orderBy(F.desc("count"), "grp")
           .limit(GROUPS - 1).collect()]
    buckets = max(1, -(-text_bytes(docs, "t") // BUCKET_BYTES))
    folder = shared_folder(spark, "lm-words")
    first = cut(_tokenise(docs, kind, top, buckets, folder), "lm-tokens")
    tokens = first.filter("numbers is not null")
    counted = cut(_sum_buckets(first.filter("packed is not null").select("pid", "bucket", "packed"), buckets), "lm-counts")
    totals = [pickle.loads(r[0]) for r in counted.filter("pid is null").select("stats").collect()]    # one row a bucket
    class_count = sum((t[0] for t in totals), np.zeros(CLASSES, np.int64))
    distinct = sum(t[1] for t in totals)
    trained = int(class_count.sum())
    rows = table_rows(trained)
    _write_dictionaries(counted.filter("pid is not null").select("pid", "packed"), buckets, folder)
    prior = np.log(np.maximum(class_count, 0.5) / max(trained, 1)).astype(np.float32)
    bias = train(tokens, folder, rows, trained, prior)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for c, known in _by_part(batches, folder):
            m = m or MaxEntModel(_read_weights(folder, rows), bias, class_count, distinct)
            got = m.score(c["numbers"], known)
            yield to_batch({"doc_id": c["id"], "held_out": [not x for x in c["learn"]], "train_tokens": [m.n] * len(c["id"])} | got, schema)

    return tokens.select("id", "pid", "learn", "numbers").mapInArrow(run, out)
