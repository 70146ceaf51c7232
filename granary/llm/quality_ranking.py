"""Quality classifier: Bradley-Terry pairwise ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stage_boundary
from ._arrow import map_batches
from ._kernel import LOWER, NOT_SPACE, class_table, hash_spans, owners, text_blocks, words

#: Labelled documents that a fit sees at most, and pairs drawn from them.
TRAIN_ROWS, PAIRS = 20_000, 200_000
#: Pairs whose differences are held at once in a step of the fit.
PAIR_BLOCK = 8192

#: ASCII punctuation, each with a share of its own.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LINE = np.ones(256, bool)
_LINE[10] = False
_UPPER, _DIGIT, _LETTER = class_table([(65, 90)]), class_table([(48, 57)]), class_table([(65, 90), (97, 122), (128, 255)])
FEATURES = 18 + len(PUNCTUATION)


def byte_counts(data: np.ndarray, offsets: np.ndarray, lot: int = 2048) -> np.ndarray:
    """How often each byte value stands in each text; some texts at a time, as each has 256 counters."""
    n = len(offsets) - 1
    out = np.empty((n, 256), np.int64)
    for i in range(0, n, lot):
        j = min(i + lot, n)
        own = data[offsets[i] : offsets[j]]
        row = np.repeat(np.arange(j - i, dtype=np.int32) << 8, np.diff(offsets[i : j + 1]))
        out[i:j] = np.bincount(row | own, minlength=(j - i) << 8).reshape(j - i, 256)
    return out


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: share of distinct hashes, and of the most frequent one; 1 and 0 without any."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    start = np.flatnonzero(fresh)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[order][start], np.diff(np.append(start, len(order))))
    distinct = np.bincount(doc[order][start], minlength=n)
    return np.where(total > 0, distinct / np.maximum(total, 1), 1.0), most / np.maximum(total, 1)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each text: shares of byte classes, lengths of words and lines, repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, FEATURES))
    if not len(data):
        out[:, [9, 11, 13]] = 1.0
        return out
    one = np.maximum(size, 1)
    starts, ends = words(data, offsets)
    doc = owners(offsets, starts)
    length = (ends - starts).astype(float)
    count = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(count, 1)
    low = LOWER[data]
    h = hash_spans(low, starts, ends)
    lines, line_ends = words(data, offsets, _LINE)
    line_doc = owners(offsets, lines)
    line_count = np.bincount(line_doc, minlength=n).astype(float)
    grams = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else h[:0]
    inside = doc[:-2] == doc[2:] if len(h) > 2 else np.zeros(0, bool)
    bytes_of = byte_counts(data, offsets)
    wordy = _LETTER[data[starts]] & _LETTER[data[ends - 1]]
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p(size)
    out[:, 2] = bytes_of[:, _UPPER].sum(axis=1) / one
    out[:, 3] = bytes_of[:, _DIGIT].sum(axis=1) / one
    out[:, 4] = bytes_of[:, _LETTER].sum(axis=1) / one
    out[:, 5] = bytes_of[:, 128:].sum(axis=1) / one
    out[:, 6] = bytes_of[:, ~NOT_SPACE].sum(axis=1) / one
    mean = np.bincount(doc, length, n) / some
    out[:, 7] = mean
    out[:, 8] = np.sqrt(np.maximum(0, np.bincount(doc, length**2, n) / some - mean**2))
    out[:, 9], out[:, 10] = _repeats(h, doc, n)
    out[:, 11], out[:, 12] = _repeats(hash_spans(low, lines, line_ends), line_doc, n)
    out[:, 13], out[:, 14] = _repeats(grams[inside], doc[:-2][inside] if len(h) > 2 else doc[:0], n)
    out[:, 15] = np.bincount(doc, wordy, n) / some
    out[:, 16] = np.bincount(doc, _UPPER[data[starts]] & _UPPER[data[ends - 1]], n) / some
    out[:, 17] = line_count / some
    out[:, 18:] = np.sqrt(bytes_of[:, list(PUNCTUATION)] / one[:, None])
    return out


@dataclass
class Ranker:
    """A document's raw score is its standardised features times weight; sigma((raw - threshold) / scale) is its score."""

    mean: np.ndarray
    deviation: np.ndarray
    weight: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Summed feature by feature, so that a text's score doesn't depend on the texts beside it in a batch."""
        z, out = np.clip((x - self.mean) / self.deviation, -8, 8), np.zeros(len(x))
        for k, w in enumerate(self.weight):
            out += z[:, k] * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale, -30, 30)))


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, steps: int = 30, seed: int = 7) -> Ranker:
    """Bradley-Terry: P(i preferred to j) = sigma(w (x_i - x_j)), fitted by Newton steps to pairs of a label-1 and a label-0 document.

    A step's gradient and curvature are sums over blocks of ``PAIR_BLOCK`` pairs, so the driver holds one block's differences, never all of them.
    The threshold is the quantile of the training scores at the share of label 0; the scale is an eighth of the distance of the classes' medians.
    Without both labels every score is 0.5.
    """
    mean, deviation = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    weight = np.zeros(x.shape[1] if x.ndim == 2 else FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    ranker = Ranker(mean, deviation, weight, 0.0, 1.0)
    if not len(good) or not len(bad):
        return ranker
    z = np.clip((x - mean) / deviation, -8, 8)
    draw = np.random.default_rng(seed)
    first, second = draw.choice(good, pairs), draw.choice(bad, pairs)
    for _ in range(steps):
        gradient, hessian = np.zeros(len(weight)), np.zeros((len(weight), len(weight)))
        for at in range(0, pairs, PAIR_BLOCK):
            d = z[first[at : at + PAIR_BLOCK]] - z[second[at : at + PAIR_BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ weight, -30, 30)))  # chance of the wrong order
            gradient -= d.T @ p
            hessian += (d * (p * (1 - p))[:, None]).T @ d
        move = np.linalg.solve(hessian / pairs + penalty * np.eye(len(weight)), gradient / pairs + penalty * weight)
        weight -= move
        if np.abs(move).max() < 1e-6:
            break
    ranker.weight = weight
    raw = ranker.raw(x)
    ranker.threshold = float(np.quantile(raw, len(bad) / len(raw), method="midpoint"))
    ranker.scale = max(1e-6, float(np.median(raw[good]) - np.median(raw[bad])) / 8)
    return ranker


def in_fold(doc_id: Column) -> Column:
    """Held out: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_ranker(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Ranker:
    """Fit to labelled documents that are not held out, ``train_rows`` labels at most, those of least id digest.

    Only their texts are read for features; the chosen labels, so bounded, are broadcast.  Equal rows of a label teach once; where a label has
    several texts, each label's first comes before any one's second, so at ``2 * train_rows`` rows all chosen labels still teach.
    """
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("y")]
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = stage_boundary(known.where(~in_fold(F.col("doc_id"))).distinct().orderBy(*order).limit(train_rows))

    def batch(b):
        for i, j, data, offs in text_blocks(b.column(2)):
            yield {"doc_id": b.column(0)[i:j], "y": b.column(1)[i:j], "key": b.column(3)[i:j], "x": list(text_features(data, offs).astype(np.float32))}

    taught = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    rows = map_batches(taught, "doc_id long, y int, key string, x array<float>", batch).dropDuplicates(["doc_id", "y", "key"])
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "y").orderBy("key")))
    rows = rows.orderBy("turn", *order, "key").limit(2 * train_rows).orderBy("doc_id", "y", "x").select("y", "x").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, FEATURES)
    return fit_ranker(x.astype(float), rows["y"].to_numpy())


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Learn to rank documents from labels and score all of them, in one pass over their whole texts.

    Features come from texts alone.  A document with several labels counts with each different one; null labels or ids teach nothing.
    Returns per input row doc_id, held_out, score (0 to 1; null and empty texts get that of an empty text), predicted (score >= 0.5), raw, and ``keep``.
    Equal texts get equal scores.  Other columns are ignored; without labels of both kinds all scores are 0.5; an empty table gives no rows.
    """
    ranker = train_ranker(df, labels, text, doc_id, label, train_rows)

    def batch(b):
        for i, j, data, offs in text_blocks(b.column(1)):
            x = text_features(data, offs).astype(np.float32).astype(float)
            s = ranker.score(x)
            out = {"_doc": b.column(0)[i:j], "score": s, "raw": ranker.raw(x), "predicted": (s >= 0.5).astype(np.int32)}
            yield out | {f"k{k}": b.column(2 + k)[i:j] for k in range(len(keep))}

    kinds = dict(df.dtypes)
    schema = "_doc long, score double, raw double, predicted int" + "".join(f", k{k} {kinds[c]}" for k, c in enumerate(keep))
    scored = map_batches(df, schema, batch, F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"), *(F.col(c).alias(f"k{k}") for k, c in enumerate(keep)))
    held = in_fold(F.col("_doc")).alias("held_out")
    own = [] if "doc_id" in keep else [F.col("_doc").alias("doc_id")]
    return scored.select(*own, held, "score", "predicted", "raw", *(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)))
