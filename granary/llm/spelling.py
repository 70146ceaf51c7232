"""Spelling variant grouping by wildcard groups, without pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import join_spans, lay_out, position, spans
from ..sources import stage_boundary
from ._arrow import map_batches, map_partition
from ._kernel import LOWER, mix64, string_column, text_blocks
from .jaccard_join import join_few

_U = np.uint64
#: Maximal runs of these characters of the text whose A-Z are lower-cased are words.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Characters of a text whose runs are counted at once.
PIECE = 1 << 20
#: Distinct words that a task holds before it hands their counts on.
LOT = 1 << 18
#: Code points of words that are expanded at once; a longer word is expanded by itself.
BLOCK_POINTS = 1 << 17
#: Stands for the replaced code point of a wildcard group; no character has this number.
WILD = 0x1FFFFF
#: Seeds of the two halves of a sequence's 128-bit hash.
LANES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text, none of which ends inside a run."""
    at = 0
    while at < len(text):
        end = at + size
        run = RUN.match(text, end - 1) if end < len(text) else None
        end = run.end() if run else min(end, len(text))
        yield text[at:end]
        at = end


def spelled(run: str, start: int, modulus: int) -> str:
    """The run, or what is left of it: where modulus divides h, the code point at h % length goes.  start: the CRC of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % modulus:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(df: DataFrame, text: str, doc_id: str, least: int, modulus: int) -> DataFrame:
    """(word, n) of each lot; a word's counts are to be summed."""

    def partition(batches):
        total: Counter = Counter()

        def lot():
            yield {"word": list(total), "n": list(total.values())}
            total.clear()

        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, data, offs in text_blocks(string_column(b.column(1))):
                low = LOWER[data]
                for d in range(j - i):
                    start = zlib.crc32(f"{ids[i + d]}:".encode())
                    for piece in pieces(low[offs[d] : offs[d + 1]].tobytes().decode()):
                        for run, n in Counter(RUN.findall(piece)).items():
                            word = spelled(run, start, modulus)
                            if len(word) >= least:
                                total[word] += n
                        if len(total) > LOT:
                            yield from lot()
        if total:
            yield from lot()

    return map_partition(df, "word string, n long", partition, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text))


def vocabulary(df: DataFrame, text: str, doc_id: str, least: int, occurrences: int, modulus: int) -> DataFrame:
    """(rank, word, n): words by n, largest first, equal ones in code-point order; a smaller rank is the better form."""
    words = count_words(df, text, doc_id, least, modulus).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)
    laid = lay_out(words, F.desc("n"), F.asc("word"))
    return stage_boundary(join_spans(laid, spans(laid)).select(position().alias("rank"), "word", "n"))


def _hash(point: np.ndarray, place: np.ndarray, lane: int) -> np.ndarray:
    """Of a code point at a place; a sequence's hash is the sum over its places, so one place can be changed without reading the others."""
    return mix64(mix64(point.astype(_U) + (place.astype(_U) << _U(21)) + _U(1)) ^ _U(lane))


def sequences(vocab: DataFrame, kind: str) -> DataFrame:
    """(k1, k2, rank): 128-bit hashes of each word ("own"), of it with each place as a wildcard ("wild"), or of its distinct deletions ("shorter").

    The cost is linear in the word's length.  A word's deletions inside a run of one letter are equal: the run's last place stands for them.
    """

    def batch(b):
        ranks = b.column(0).to_numpy(zero_copy_only=False)
        column = string_column(b.column(1))
        length = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, _ in text_blocks(column, BLOCK_POINTS):
            point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
            n = length[i:j]
            first = np.cumsum(n) - n
            owner = np.repeat(np.arange(j - i), n)
            place = np.arange(len(point)) - first[owner]
            keys, keep = [], slice(None)
            for lane in LANES:
                z = _hash(point, place, lane)
                total = np.add.reduceat(z, first)
                if kind == "own":
                    keys.append(total)
                elif kind == "wild":
                    keys.append(total[owner] - z + _hash(np.full(len(point), WILD), place, lane))
                else:
                    moved = np.where(place > 0, _hash(point, place - (place > 0), lane), _U(0))
                    upto, behind = np.cumsum(z) - z, np.cumsum(moved)
                    last = first + n - 1
                    keys.append(upto - upto[first][owner] + behind[last][owner] - behind)
            if kind == "shorter":
                keep = np.concatenate((point[1:] != point[:-1], [True])) | (place == n[owner] - 1)
            own = np.arange(j - i) if kind == "own" else owner
            yield {"k1": keys[0].view(np.int64)[keep], "k2": keys[1].view(np.int64)[keep], "rank": ranks[i:j][own][keep]}

    return map_batches(vocab, "k1 long, k2 long, rank long", batch, "rank", "word")


def replacements(vocab: DataFrame) -> DataFrame:
    """(rank, near, best): per word and wildcard group, the group's other words and the best of them.

    A group keeps its size and its two best words: a word's best neighbour is the group's best, and the second for the best itself.
    """
    group = Window.partitionBy("k1", "k2")
    seen = sequences(vocab, "wild").select("rank", F.count("*").over(group).alias("size"), F.min("rank").over(group).alias("one"), F.lead("rank").over(group.orderBy("rank")).alias("next"))
    return seen.where("size > 1").select("rank", (F.col("size") - 1).alias("near"), F.when(F.col("rank") == F.col("one"), F.col("next")).otherwise(F.col("one")).alias("best"))


def indels(vocab: DataFrame) -> DataFrame:
    """(rank, near, best): for each word that is another's deletion, a row for either."""
    met = sequences(vocab, "shorter").withColumnRenamed("rank", "long").join(sequences(vocab, "own").withColumnRenamed("rank", "short"), ["k1", "k2"])
    ends = F.array(F.struct(F.col("long").alias("rank"), F.col("short").alias("best")), F.struct(F.col("short").alias("rank"), F.col("long").alias("best")))
    return met.select(F.inline(ends)).select("rank", F.lit(1).cast("long").alias("near"), "best")


def last_forms(forms: DataFrame) -> DataFrame:
    """(rank, root) from (rank, form): forms followed to the last by doubling: each round a word takes its present form's form.

    Along a chain n doubles at least, so a chain is as long as a logarithm of the largest n, and the rounds are as many as that length's logarithm.
    """
    now = forms.select("rank", F.col("form").alias("root"))
    while True:
        now = stage_boundary(now)
        step = join_few(now, now.select(F.col("rank").alias("root"), F.col("root").alias("_further")), "root", "rank")
        if step.isEmpty():
            return now
        now = now.join(step.select("rank", "_further"), "rank", "left").select("rank", F.coalesce("_further", "root").alias("root"))


def group_variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 5, occurrences: int = 3, modulus: int = 97, factor: int = 2) -> DataFrame:
    """Words of all texts with the more frequent spelling that each is a variant of.

    Words: maximal runs of Latin letters (A-Z lower-cased), of which those whose CRC-32 with their doc_id is a multiple of ``modulus`` lose a code
    point; of ``least`` code points and ``occurrences`` places or more.  Two are near if one inserted, deleted or replaced code point tells them apart.
    A word's form is its near word of largest n (of equal ones the first in code-point order), where that has ``factor`` times its n or more.

    1. Words are counted in the mappers first, then ranked by n in sampled ranges, so that the best of several words is the least rank.
    2. Replacements: each word gives one hash per place, of itself with a wildcard there; equal hashes are one (place, prefix, suffix) group, which keeps its
       size and two best words.  It has as many words as there are letters at most, so no group is large.
    3. Insertions and deletions: hashes of a word's distinct deletions meet those of the words.
    4. Both are summed per word; no pair of words of a group is made.  Roots follow forms by doubling.

    Returns one row per word: word, form, root (the word itself without a form), n, n_near, form_n.  Sequences are compared by 128-bit hashes.
    Null and empty texts have no words; a null doc_id counts as the text "null"; rows that repeat count again; further columns are ignored; an empty
    table gives no rows.  A text is read whole, in pieces that end between runs; a run of any length is one word, at a cost linear in its length.
    """
    vocab = vocabulary(df, text, doc_id, least, occurrences, modulus)
    near = replacements(vocab).unionByName(indels(vocab)).groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    near = stage_boundary(near)
    best = vocab.select(F.col("rank").alias("best"), F.col("n").alias("best_n"), F.col("word").alias("form"))
    judged = join_few(near.join(vocab.select("rank", "n"), "rank"), best, "best", "rank").withColumn("good", F.col("best_n") >= factor * F.col("n"))
    judged = stage_boundary(judged.select("rank", "n_near", F.when(F.col("good"), F.col("best")).alias("best"), F.when(F.col("good"), F.col("form")).alias("form"), F.when(F.col("good"), F.col("best_n")).alias("form_n")))
    roots = last_forms(judged.where("best IS NOT NULL").select("rank", F.col("best").alias("form")))
    roots = join_few(roots, vocab.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root", "rank").select("rank", "root_word")
    out = vocab.join(judged, "rank", "left").join(roots, "rank", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
