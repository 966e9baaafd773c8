"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): pairwise interactions of all features in time
linear in their number. Features are the distinct words of the whole text hashed to WORDS buckets, and one bin of each
statistic (shares of capitals, digits, marks and bars, repeats of words and lines, lengths). It is trained by Adam on at most
TRAIN_ROWS labelled ids, those with the least xxhash64, which is the only bound on what it learns from; of an id's texts, the least.

A row's features come as two bytes each, of which there are at most DIMS different ones, so the driver holds 400 MB at worst.

Null and empty texts have no words and the statistics of an empty text; they get a score like any other. Without any labelled row
of both kinds the score is 0.5 everywhere. An id with several labels counts once, with the greatest; labels of null ids or null labels are
left out. Texts are scored whole, whatever their length. Repeated rows are scored each. An empty
table gives an empty result. Extra columns are ignored; a row scores alike wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import bucket_of, chunks, map_batches
from tipoff.llm.hashing import Prefix

TRAIN_ROWS = 12_000
WORDS, BINS, FACTORS = 1 << 14, 16, 8
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.02, 1e-5
SHARES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.14, 0.22, 0.32, 0.45, 0.6, 0.75, 0.9, 0.97])
STATS = ("capitals", "digits", "marks", "ends", "bars", "shouts", "non_ascii", "space", "line_share", "same_as_last", "distinct_words", "distinct_lines", "long_words", "n_bytes", "n_words", "n_lines", "word_length")
DIMS = len(STATS) * BINS + WORDS


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, where each text's begin) of a few megabytes of texts at most."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts = ends - np.array([len(r) + 1 for r in raw])
    size = ends - starts - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends - 1] - total[starts]

    before = np.concatenate([[0], data[:-1]])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    capital = (data >= 65) & (data <= 90) | (before == 0xC3) & (data >= 0x80) & (data <= 0x9E)
    digit = (data >= 48) & (data <= 57)
    end_mark = (data == 46) | (data == 44)
    bar, shout = data == 124, data == 33
    letter = (data >= 97) & (data <= 122) | (data >= 65) & (data <= 90) | (data >= 128)
    mark = ~(space | digit | end_mark | letter | bar | shout)
    prefix = Prefix(data)
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.astype(np.int8)])))
    first, last = edge[::2], edge[1::2]
    words = prefix.of(first, last)
    owner = np.searchsorted(ends, first, "right")
    n_words = np.bincount(owner, minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    line = prefix.of(line_start, breaks)
    line_owner = np.searchsorted(ends, line_start, "right")
    n_lines = np.bincount(line_owner, minlength=n)
    share = lambda a, b: a / np.maximum(b, 1)
    lower = np.where(size > 0, size, 1)
    values = [
        count(capital) / lower, count(digit) / lower, count(mark) / lower, count(end_mark) / lower, count(bar) / lower, count(shout) / lower, count(data >= 128) / lower, count(space) / lower,
        share(n_lines, n_words), share(np.bincount(owner, weights=same, minlength=n), n_words), share(_distinct(owner, words, n), n_words), share(_distinct(line_owner, line, n), n_lines),
        share(np.bincount(owner, weights=last - first > 20, minlength=n), n_words),
    ]
    bins = [np.searchsorted(SHARES, v) for v in values]
    bins += [np.minimum(BINS - 1, np.log2(v + 1).astype(int)) for v in (size, n_words, n_lines)]
    bins.append(np.minimum(BINS - 1, share(size, n_words).astype(int)))
    stats = np.stack(bins, axis=1) + np.arange(len(STATS)) * BINS
    hashed = np.unique(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64))
    who = hashed // WORDS
    n_hashed = np.bincount(who, minlength=n)
    at = np.concatenate([[0], np.cumsum(n_hashed + len(STATS))])
    idx, x = np.empty(at[-1], np.int32), np.ones(at[-1], np.float32)
    where = (at[:-1, None] + np.arange(len(STATS))).ravel()
    idx[where] = stats.ravel()
    rest = np.ones(at[-1], bool)
    rest[where] = False
    idx[rest] = hashed % WORDS + len(STATS) * BINS
    x[rest] = (1 / np.sqrt(np.maximum(n_hashed, 1)))[who]
    return idx, x, at


def values_of(idx: np.ndarray) -> np.ndarray:
    """Values of one text's features, as features() gives them."""
    word = idx >= len(STATS) * BINS
    return np.where(word, 1 / np.sqrt(max(1, int(word.sum()))), 1).astype(np.float32)


class Machine:
    """A factorisation machine of binary targets."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, idx: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        vx = self.factors[idx] * x[:, None]
        sums, squares = np.add.reduceat(vx, at[:-1]), np.add.reduceat(vx * vx, at[:-1])
        z = self.bias + np.add.reduceat(self.weights[idx] * x, at[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    @classmethod
    def trained(cls, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
        """rows: feature numbers of each example."""
        rng = np.random.default_rng(seed)
        rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
        w = np.zeros((DIMS, FACTORS + 1), np.float32)
        w[:, 1:] = rng.normal(0, 0.02, (DIMS, FACTORS))
        m, v = np.zeros_like(w), np.zeros_like(w)
        bias, step = float(np.log(rate / (1 - rate))), 0
        for _ in range(EPOCHS if len(set(labels.tolist())) > 1 else 0):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                idx, x = np.concatenate([rows[i] for i in some]).astype(np.int32), np.concatenate([values_of(rows[i]) for i in some])
                at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])
                error = (cls(bias, w[:, 0], w[:, 1:]).score(idx, x, at) - labels[some]).astype(np.float32) / len(some)
                each = np.repeat(error, np.diff(at)) * x
                vx = w[idx, 1:] * x[:, None]
                grads = np.concatenate([each[:, None], each[:, None] * (np.repeat(np.add.reduceat(vx, at[:-1]), np.diff(at), axis=0) - vx)], axis=1)
                order2 = np.argsort(idx, kind="stable")
                cells, first = np.unique(idx[order2], return_index=True)
                g = np.add.reduceat(grads[order2], first) + DECAY * w[cells]
                step += 1
                m[cells] = 0.9 * m[cells] + 0.1 * g
                v[cells] = 0.99 * v[cells] + 0.01 * g * g
                w[cells] -= RATE * (m[cells] / (1 - 0.9**step)) / (np.sqrt(v[cells] / (1 - 0.99**step)) + 1e-6)
                bias -= RATE * float(error.sum())
        if len(set(labels.tolist())) < 2:
            return cls(0.0, np.zeros(DIMS, np.float32), np.zeros((DIMS, FACTORS), np.float32))
        return cls(bias, np.ascontiguousarray(w[:, 0]), np.ascontiguousarray(w[:, 1:]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """Train on labelled rows whose crc32(id as text) mod folds is not held_out; at most `rows` of them."""
    usable = labels.filter(F.col(label_col).isNotNull() & (bucket_of(F.col(id_col), folds) != held_out)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(rows)

    def make():
        def step(batch):
            out = []
            for some in chunks(batch.column(1).to_pylist()):
                idx, _, at = features(some)
                idx = idx.astype(np.uint16)
                out += [idx[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["label", "idx"])

        return step

    # one text an id, so a repeated id adds no rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    picked = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
    table = map_batches(picked, make, "label int, idx binary").toArrow()
    examples = sorted(zip(table["idx"].to_pylist(), table["label"].to_pylist(), strict=True))
    return Machine.trained([np.frombuffer(i, np.uint16) for i, _ in examples], np.array([y for _, y in examples], np.float32))


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.7, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, held_out, score, predicted, and the columns `keep` of the input."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((machine.bias, machine.weights, machine.factors))

    def make():
        own = Machine(*shared.value)

        def step(batch):
            score = np.concatenate([own.score(*features(some)) for some in chunks(batch.column(1).to_pylist())])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(batch.column(k + 2) for k in range(len(keep)))], [id_col, "score", "predicted", *(f"_{c}" for c in keep)])

        return step

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{id_col}` {kind[id_col]}", "score double", "predicted int", *(f"`_{c}` {kind[c]}" for c in keep)])
    out = map_batches(docs.select(id_col, text_col, *keep), make, schema)
    return out.select(id_col, (bucket_of(F.col(id_col), folds) == held_out).alias("held_out"), "score", "predicted", *(F.col(f"_{c}").alias(c) for c in keep))
