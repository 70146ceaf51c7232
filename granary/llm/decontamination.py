"""Benchmark decontamination: rare word-pair seeds joined with documents, losing no copy, and Smith-Waterman alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import join_spans, lay_out, position, spans
from ..sources import stage_boundary
from ._arrow import map_batches
from ._kernel import LOWER, class_table, hash_spans, mix64, owners, text_blocks, words
from ._packed import blobs, deal, exchange, map_packed, pack, parts_of, unpack
from .jaccard_join import join_few, join_text
from .substring_dedup import with_refs

_U = np.uint64
#: Words: letters, digits and characters beyond ASCII, in lower case (ASCII and Latin-1 letters); punctuation and layout never count.
WORD_BYTES = ~class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Alignment: points for an equal word, another word, a gap; share of an item's best possible score from which a passage is a copy.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Points that are a copy whatever the item's length (25 words in a row), and points that a short item asks for, all of its own if it has fewer.
LONG_POINTS, SHORT_POINTS = 50, 15
#: Measured bytes of items up to which they are broadcast with their seeds; a larger benchmark's seeds are joined by a shuffle.
BROADCAST = 4 << 20
#: Counters of the sketch of pair frequencies, and bits of the filter before a shuffle of seeds: of a fixed size, whatever corpus and benchmark.
SKETCH_BITS, FILTER_BITS = 17, 26
#: Items whose words come to a document at once.
BUNDLE = 64
#: Seeds that are held at once; a text block with more is matched with parts of the items in turn.
HITS = 1 << 21


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and its document."""
    low = LOWER[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[latin] += 0x20
    starts, ends = words(low, offsets, WORD_BYTES)
    return hash_spans(low, starts, ends), owners(offsets, starts)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a) * _U(31) + b)


def needed(size: int, least: float) -> int:
    """Points from which a passage is a copy of an item of ``size`` words."""
    return min(LONG_POINTS, max(1, math.ceil(least * MATCH * size - 1e-9), min(MATCH * size, SHORT_POINTS)))


@dataclass
class Items:
    """Benchmark items: word hashes of each, points and width that their copies have, and pairs by hash with item, place and distance.

    Of an alignment's matches in a row, let g0 pairs have no error between them, g1 one and g2 two or more: its points are at most
    2 + 2 g0 + g1, as each match gives two and each error takes one.  So a copy of T points holds pairs worth T - 2, a pair of neighbours being
    worth 2 and one with a word more on either side or both 1.  A copy begins and ends with pairs, because what lies beyond them takes as much as it
    gives.  So pairs begin at (T - 2) / 2 or more of the item's places.  Seeds are the pairs at all places but the commonest, of which half as
    many are left out as a copy must hold: the other half a copy holds in any case.  Only documents with so many seeds of an item are looked
    at by all of its pairs, and aligned.  Items that two points or fewer satisfy have their single words, rare or not.
    """

    ids: list[int]
    words: list[np.ndarray]
    need: np.ndarray
    width: np.ndarray  # words that the best alignment of a copy spans at most
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # sorted hash, item, place, distance
    singles: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    rare: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    hits: np.ndarray  # places with seeds that a copy has at least


def _sorted_seeds(lots: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([x for x, _, _ in lots] or [np.zeros(0, _U)])
    sizes = [len(x) for x, _, _ in lots]
    item, distance = (np.repeat(np.array([lot[k] for lot in lots], np.int64), sizes) for k in (1, 2))
    at = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])
    order = np.argsort(h, kind="stable")
    return h[order], item[order], at[order], distance[order]


def least_places(need: int) -> int:
    """Places of an item at which pairs of a copy of so many points begin, at least."""
    return max(1, -(-(need - MATCH) // MATCH))


def seed_places(own: np.ndarray, need: int, often: np.ndarray) -> tuple[np.ndarray, int]:
    """(places whose pairs are seeds, how many of them a copy holds at least): the commonest places are left out, by the sketch."""
    n = len(own) - 1
    common = np.zeros(n, np.int64)
    for d in (1, 2):
        if len(own) > d:
            common[: len(own) - d] += often[_pair(own[:-d], own[d:]) >> _U(64 - SKETCH_BITS)]
    all_places = least_places(need)
    out = min(all_places // 2, n - 1)
    return np.sort(np.argsort(common, kind="stable")[: n - out]), all_places - out


def read_items(rows: list[tuple[int, str]], least: float = LEAST_SCORE, often: np.ndarray | None = None) -> Items:
    often = np.zeros(1 << SKETCH_BITS, np.int64) if often is None else often
    raw = [(t or "").encode() for _, t in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    h, doc = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    cuts = np.searchsorted(doc, np.arange(len(rows) + 1))
    own = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    need = np.array([needed(len(w), least) for w in own], np.int64)
    width = np.array([(1 + MATCH) * len(w) for w in own], np.int64) - need
    pairs = [(_pair(w[:-d], w[d:]), k, d) for k, w in enumerate(own) for d in (1, 2) if need[k] > MATCH and len(w) > d]
    singles = [(w, k, 1) for k, w in enumerate(own) if need[k] <= MATCH]
    table, hits = _sorted_seeds(pairs), np.ones(len(own), np.int64)
    first = np.concatenate(([0], np.cumsum([len(w) for w in own]))).astype(np.int64)
    keep = np.zeros(int(first[-1]), bool)
    for k, w in enumerate(own):
        if need[k] > MATCH and len(w) > 1:
            places, hits[k] = seed_places(w, int(need[k]), often)
            keep[first[k] + places] = True
    seed = keep[first[table[1]] + table[2]]
    return Items([i for i, _ in rows], own, need, width, table, _sorted_seeds(singles), tuple(c[seed] for c in table), hits)


def _lookup(h: np.ndarray, real: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, first seed, seeds) of each hash that is a seed."""
    bits = min(24, max(16, len(seed).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    table[seed >> _U(64 - bits)] = True
    near = np.flatnonzero(table[h >> _U(64 - bits)] & real)
    low, high = np.searchsorted(seed, h[near], "left"), np.searchsorted(seed, h[near], "right")
    some = high > low
    return near[some], low[some], (high - low)[some]


def find_seeds(h: np.ndarray, doc: np.ndarray, items: Items, pairs: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word's place, item, place in the item, worth) of each pair met, all of an item together; none crosses documents."""
    met = [(*_lookup(_pair(h[:-d], h[d:]), doc[:-d] == doc[d:], pairs[0]), d, pairs) for d in (1, 2) if len(h) > d and len(pairs[0])]
    if len(items.singles[0]):
        met.append((*_lookup(h, np.ones(len(h), bool), items.singles[0]), 1, items.singles))
    total = sum(int(count.sum()) for _, _, count, _, _ in met)
    parts = min(len(items.ids), -(-total // HITS))
    for part in range(parts):
        out = []
        for near, low, count, d, (_, item, at, distance) in met:
            if parts > 1:  # seeds before each one that are of this part's items
                mine = np.flatnonzero(item % parts == part)
                a, z = np.searchsorted(mine, low), np.searchsorted(mine, low + count)
                near, low, count = near[z > a], a[z > a], (z - a)[z > a]
            which = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            which = mine[which] if parts > 1 else which
            out.append((np.repeat(near, count), item[which], at[which], np.where((distance[which] == 1) & (d == 1), 2, 1)))
        yield tuple(np.concatenate(c) for c in zip(*out, strict=True))


def candidates(h: np.ndarray, doc: np.ndarray, items: Items) -> np.ndarray:
    """Codes document * items + item, ascending, of documents that hold as many of an item's seeds as a copy does."""
    out = [np.zeros(0, np.int64)]
    for place, item, at, _ in find_seeds(h, doc, items, items.rare):
        if len(place):
            code = np.unique(np.stack((doc[place] * len(items.ids) + item, at), axis=1), axis=0)[:, 0]
            code, n = np.unique(code, return_counts=True)
            out.append(code[n >= items.hits[code % len(items.ids)]])
    return np.unique(np.concatenate(out))


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each row of a (items, padded with 0) against the same row of b (passages, padded with 1): best score, first word, end.

    One row of all matrices at a step; a cell holds its score above the place where its alignment began, the later beginnings being the larger.
    """
    shift, most = 1 << 24, (1 << 24) - 1
    k, n = b.shape
    column = np.arange(n + 1)
    zero = np.broadcast_to(most - column, (k, n + 1))
    h = zero.copy()
    best = np.zeros((k, 3), np.int64)
    row = np.arange(k)
    for i in range(a.shape[1]):
        real = a[:, i] != 0
        step = np.where(b == a[:, i, None], MATCH, MISMATCH) * shift
        e = zero.copy()
        e[:, 1:] = np.maximum(e[:, 1:], np.maximum(h[:, :-1] + step, h[:, 1:] + GAP * shift))
        # Gaps along the passage: the best of all earlier cells less one point for each step.
        e = np.maximum.accumulate(e - GAP * shift * column, axis=1) + GAP * shift * column
        e = np.maximum(e, zero)
        h = np.where(real[:, None], e, h)
        j = np.argmax(h >> 24, axis=1)
        s = h[row, j] >> 24
        better = real & (s > best[:, 0])
        best[better] = np.stack((s, most - (h[row, j] & most), j), axis=1)[better]
    return best[:, 0], best[:, 1], best[:, 2]


def passages(place: np.ndarray, item: np.ndarray, at: np.ndarray, worth: np.ndarray, doc: np.ndarray, end: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, end, seeds) of each stretch of words that may hold a copy, by the worth of its seeds."""
    order = np.lexsort((-worth, place, item, doc[place]))
    place, item, at, worth = place[order], item[order], at[order], worth[order]
    need, width = items.need[item] - MATCH, items.width[item]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (doc[place][1:] != doc[place][:-1]) | (item[1:] != item[:-1])
    key = (np.cumsum(fresh) - 1) * (int(place.max()) + int(width.max()) + 2) + place
    # Worth of the windows that begin at a seed; a word begins one pair of an alignment at most.
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    total = np.concatenate(([0], np.cumsum(np.where(first, worth, 0))))
    good = np.flatnonzero(first & (total[np.searchsorted(key, key + width)] - total[np.arange(len(key))] >= need))
    if not len(good):
        return
    apart = np.ones(len(good), bool)
    apart[1:] = key[good][1:] > key[good][:-1] + width[good][1:]
    start = good[apart]
    last = good[np.append(np.flatnonzero(apart)[1:], len(good)) - 1]
    stop = np.searchsorted(key, key[last] + width[last])
    # A word of the item, too, begins one pair at most.
    stretch = np.repeat(np.arange(len(start)), stop - start)
    inside = np.repeat(start, stop - start) + np.arange(len(stretch)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
    by_item = np.lexsort((-worth[inside], at[inside], stretch))
    s, a, w = stretch[by_item], at[inside][by_item], worth[inside][by_item]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (a[1:] != a[:-1])
    enough = np.bincount(s[once], w[once], len(start)) >= need[start]
    for b, z, e in zip(start[enough].tolist(), last[enough].tolist(), stop[enough].tolist(), strict=True):
        own = int(doc[place[b]])
        yield own, int(item[b]), int(place[b]), min(int(end[own]), int(place[z]) + int(width[b]) + 2), e - b


def match_block(h: np.ndarray, doc: np.ndarray, n: int, items: Items) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """(score, first word, end, seeds) of the best passage of each document and item, where it is a copy."""
    out: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    code = candidates(h, doc, items)
    if not len(code):
        return out
    some = np.zeros(n, bool)
    some[code // len(items.ids)] = True
    h, doc = h[some[doc]], doc[some[doc]]  # whole documents, the others aside
    n_words = np.bincount(doc, minlength=n)
    last = np.cumsum(n_words)
    first = last - n_words
    met = (tuple(c[np.isin(doc[seeds[0]] * len(items.ids) + seeds[1], code)] for c in seeds) for seeds in find_seeds(h, doc, items, items.pairs))
    todo = sorted((p for seeds in met if len(seeds[0]) for p in passages(*seeds, doc, last, items)), key=lambda p: (len(items.words[p[1]]), p[3] - p[2]))
    lot, cells = [], 0
    for i, p in enumerate(todo):
        lot.append(p)
        cells += p[3] - p[2]
        if cells < 1 << 16 and i + 1 < len(todo):
            continue
        rows, columns = max(len(items.words[p[1]]) for p in lot), max(p[3] - p[2] for p in lot)
        a, b = np.zeros((len(lot), rows), _U), np.ones((len(lot), columns), _U)
        for r, (_, k, low, high, _) in enumerate(lot):
            a[r, : len(items.words[k])] = items.words[k]
            b[r, : high - low] = h[low:high]
        score, begin, end = align(a, b)
        for (own, k, low, _, seeds), s, x, y in zip(lot, score.tolist(), begin.tolist(), end.tolist(), strict=True):
            if s >= items.need[k]:
                mine = (s / (MATCH * len(items.words[k])), low + x - int(first[own]), low + y - int(first[own]), seeds)
                if (own, k) not in out or (mine[0], -mine[1]) > (out[own, k][0], -out[own, k][1]):
                    out[own, k] = mine
        lot, cells = [], 0
    return out


def _bounded_sum(packed: DataFrame, parts: int, size: int, join: np.ufunc, kind: str) -> np.ndarray:
    """An array of a fixed size from packed (place, value) of all tasks, joined by place on executors."""

    def partition(batches):
        at, value = unpack([b for _, b in blobs(batches).get(0, [])], ["<i4", kind])
        place, inverse = np.unique(at, return_inverse=True)
        out = np.zeros(len(place), kind)
        join.at(out, inverse, value)
        yield 0, 0, pack([place, out])

    whole = np.zeros(size, kind)
    for r in map_packed(exchange(packed, parts), partition).select("blob").collect():  # size entries in all, each once
        at, value = unpack([r.blob], ["<i4", kind])
        whole[at] = value
    return whole


def pair_frequencies(df: DataFrame, text: str) -> np.ndarray:
    """Counters of all word pairs of the corpus, by the upper bits of their hashes.  They only order an item's places, so they change no result."""
    parts = min(parts_of(df), 16)

    def partition(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for _, _, data, offs in text_blocks(b.column(0)):
                h, doc = word_hashes(data, offs)
                for d in (1, 2):
                    if len(h) > d:
                        total += np.bincount((_pair(h[:-d], h[d:])[doc[:-d] == doc[d:]] >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(total).astype(np.int32)
        yield from deal(0, (at.astype(np.int64) * parts >> SKETCH_BITS).astype(np.int32), [at, total[at]])

    return _bounded_sum(map_packed(df, partition, F.col(text)), parts, 1 << SKETCH_BITS, np.add, "<i8")


def item_table(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    """(k, i, t): distinct items with their number, by id, then text."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    laid = lay_out(rows, "i", "t")
    return stage_boundary(join_spans(laid, spans(laid)).select(position().alias("k"), "i", "t"))


def few_items(table: DataFrame, least: float, often: np.ndarray, most: int) -> Items | None:
    """All items, if their bytes, which are summed first, are no more than ``most``; None for a larger benchmark."""
    if (table.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0) > most:
        return None
    return read_items([(r.i, r.t) for r in table.sort("k").collect()], least, often)


SEEDS = "h long, k long, place long, hits long"


def item_seeds(table: DataFrame, least: float, often) -> DataFrame:
    """(h, k, place, hits): the seeds of a benchmark of any size, made where its rows are; hits: places that a copy holds at least."""

    def batch(b):
        ks = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, b.num_rows, BUNDLE):
            items = read_items([(0, t) for t in b.column(1)[i : i + BUNDLE].to_pylist()], least, often.value)
            for h, item, place, _ in (items.rare, items.singles):
                yield {"h": h.view(np.int64), "k": ks[i + item], "place": place, "hits": items.hits[item]}

    return map_batches(table, SEEDS, batch, "k", "t")


def seed_filter(seeds: DataFrame, parts: int) -> np.ndarray:
    """A bitmap of the seeds' hashes, of a fixed size: it spares the shuffle what surely isn't a seed, and loses none."""

    def partition(batches):
        for b in batches:
            at, inverse = np.unique((b.column(0).to_numpy(zero_copy_only=False).view(_U) >> _U(64 - FILTER_BITS)).astype(np.int64) >> 6, return_inverse=True)
            bit = np.zeros(len(at), _U)
            np.bitwise_or.at(bit, inverse, _U(1) << ((b.column(0).to_numpy(zero_copy_only=False).view(_U) >> _U(64 - FILTER_BITS)) & _U(63)))
            yield from deal(0, (at * parts >> (FILTER_BITS - 6)).astype(np.int32), [at.astype(np.int32), bit])

    return _bounded_sum(map_packed(seeds, partition, "h"), parts, 1 << (FILTER_BITS - 6), np.bitwise_or, "<u8")


def joined_candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ref, k) of documents that hold as many of an item's seeds as a copy does, by a join on the seeds' hashes."""
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds, min(parts_of(docs), 16)))

    def batch(b):
        refs, own = b.column(0).to_numpy(zero_copy_only=False), bits.value
        for i, _, data, offs in text_blocks(b.column(1)):
            h, doc = word_hashes(data, offs)
            found = [np.stack((h, doc.astype(_U)))] + [np.stack((_pair(h[:-d], h[d:])[same], doc[:-d][same].astype(_U))) for d in (1, 2) if len(h) > d for same in [doc[:-d] == doc[d:]]]
            key, owner = np.concatenate(found, axis=1)
            at = key >> _U(64 - FILTER_BITS)
            met = (own[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
            if met.any():
                pair = np.unique(np.stack((key[met], owner[met])), axis=1)
                yield {"h": pair[0].view(np.int64), "ref": refs[i + pair[1].astype(np.int64)]}

    met = map_batches(docs, "h long, ref long", batch, "ref", "text").join(seeds, "h")
    return met.groupBy("ref", "k").agg(F.count_distinct("place").alias("n"), F.first("hits").alias("hits")).where("n >= hits").select("ref", "k")


LEAKS = "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long"


def align_joined(docs: DataFrame, pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """(ref, leaks) of candidate documents and items: an item's text comes to its documents in bundles of at most BUNDLE items."""
    part = F.floor(F.col("k") / BUNDLE).alias("bundle")
    asked = stage_boundary(pairs.groupBy("ref", part).agg(F.collect_list("k").alias("ks")))
    bundles = stage_boundary(table.groupBy(part).agg(F.collect_list(F.struct("k", "i", "t")).alias("items")))
    rows = join_text(docs.select("ref", "doc_id", "text").distinct(), asked)
    rows = join_few(rows, bundles, "bundle").select("ref", "doc_id", "text", "ks", "items")

    def batch(b):
        for r in range(b.num_rows):
            asked = set(b.column(3)[r].as_py())
            own = sorted(((x["k"], x["i"], x["t"]) for x in b.column(4)[r].as_py() if x["k"] in asked), key=lambda x: x[0])
            items = read_items([x[1:] for x in own], least)
            for _, _, data, offs in text_blocks(b.column(2).slice(r, 1)):
                found = sorted(match_block(*word_hashes(data, offs), 1, items).items())
                if found:
                    yield {
                        "ref": [b.column(0)[r].as_py()] * len(found), "item_id": [items.ids[k] for (_, k), _ in found], "score": [v[0] for _, v in found],
                        "first_word": [v[1] for _, v in found], "end_word": [v[2] for _, v in found], "n_seeds": [v[3] for _, v in found],
                    }

    return map_batches(rows, LEAKS.replace("doc_id", "ref"), batch)


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", least: float = LEAST_SCORE, broadcast: int = BROADCAST) -> DataFrame:
    """Passages of documents that are copies of benchmark items, edited or paraphrased ones too.

    1. One scan counts all word pairs of the corpus in a sketch of a fixed size.  Each item's seeds are its pairs, the commonest places aside; any
       copy holds a known number of them, whatever the corpus, so none is lost.
    2. A second scan joins seeds with documents: by a broadcast of the items if their measured bytes are ``broadcast`` or fewer, else by a shuffle of the
       hashes that pass a filter of a fixed size.  Two scans, whatever the benchmark.
    3. Documents with enough seeds of an item are looked at by all of its pairs; stretches that hold enough of them are aligned with it word by word.

    Score: the alignment's points over those of the whole item.
    Returns (doc_id, item_id, score, first_word, end_word, n_seeds), the best passage of each document row and item with score >= ``least`` or
    ``LONG_POINTS`` points; one of an item below eight words is all of it, of a somewhat longer one ``SHORT_POINTS`` points.
    Null texts and items of no words have none; a repeated document row gives its rows again, a repeated item counts once per text; null ids stay null.
    Texts of any length are read whole.  Further columns are ignored; an empty table on either side gives no rows.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table, often = item_table(benchmark, item_text, item_id), pair_frequencies(own, "text")
    items = few_items(table, least, often, broadcast)
    context = df.sparkSession.sparkContext
    if items is None:
        docs = with_refs(own, "text", "doc_id")
        seeds = stage_boundary(item_seeds(table, least, context.broadcast(often)))
        found = stage_boundary(align_joined(docs, joined_candidates(docs, seeds), table, least))
        return docs.select("doc_id", "ref").join(found, "ref").select(*(x.split()[0] for x in LEAKS.split(", ")))
    seeded = context.broadcast(items)

    def batch(b):
        for i, j, data, offs in text_blocks(b.column(1)):
            h, doc = word_hashes(data, offs)
            found = sorted(match_block(h, doc, j - i, seeded.value).items())
            if found:
                ids = b.column(0)[i:j].to_pylist()
                yield {
                    "doc_id": [ids[d] for (d, _), _ in found], "item_id": [seeded.value.ids[k] for (_, k), _ in found], "score": [v[0] for _, v in found],
                    "first_word": [v[1] for _, v in found], "end_word": [v[2] for _, v in found], "n_seeds": [v[3] for _, v in found],
                }

    return map_batches(own, LEAKS, batch, "doc_id", "text")


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", least: float = LEAST_SCORE, broadcast: int = BROADCAST) -> DataFrame:
    """df without the rows that hold a copy of an item, found as find_leaks does.

    With broadcast items a row is decided where it is read; else the documents found are taken out by a join.  Null texts hold none and stay; of
    repeated rows all stay or none; all columns are kept; an empty table gives no rows, an empty benchmark takes none.
    """
    table, often = item_table(benchmark, item_text, item_id), pair_frequencies(df, text)
    items = few_items(table, least, often, broadcast)
    context, names = df.sparkSession.sparkContext, df.columns
    if items is None:
        docs = with_refs(df, text, doc_id, tuple(names))
        seeds = stage_boundary(item_seeds(table, least, context.broadcast(often)))
        found = stage_boundary(align_joined(docs, joined_candidates(docs, seeds), table, least).select("ref").distinct())
        return docs.join(found, "ref", "left_anti").select(*(F.col(f"keep{k}").alias(c) for k, c in enumerate(names)))
    seeded = context.broadcast(items)

    def batch(b):
        clean = np.ones(b.num_rows, bool)
        for i, j, data, offs in text_blocks(b.column(names.index(text))):
            h, doc = word_hashes(data, offs)
            for d, _ in match_block(h, doc, j - i, seeded.value):
                clean[i + d] = False
        kept = b.filter(pa.array(clean))
        yield {f"k{k}": kept.column(k) for k in range(len(names))}

    kinds = dict(df.dtypes)
    schema = ", ".join(f"k{k} {kinds[c]}" for k, c in enumerate(names))
    return map_batches(df, schema, batch, *(F.col(c).alias(f"k{k}") for k, c in enumerate(names))).select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(names)))
