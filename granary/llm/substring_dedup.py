"""Removal of byte strings that stand earlier in the corpus, by shards of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stage_boundary
from ._anchors import anchored_places, anchored_runs, side_marks
from ._arrow import map_batches, map_partition
from ._kernel import buffers, hash_spans, mix64, text_blocks
from ._packed import blobs, deal, exchange, map_packed, pack, parts_of, unpack
from .suffix_array import permuted_prefixes, suffix_array

#: Bytes of an anchor's gram.
GRAM = 16
#: Records that a mapper holds before it collapses and sends them.
FLUSH = 1 << 20
#: Bytes of one suffix array.
SHARD_BYTES = 4 << 20
#: Contexts of one anchor that go to shards, beyond which further anchors split them.
HOT = 1 << 14

_ANCHORS = ["<u8", "<u8", "<i8", "<i4", "<i4", "<u4", "<u4"]  # anchor, context's hash, document, start, length, marks of the anchor's sides
_SPANS = ["<i8", "<i8", "<i8"]  # document, start, end
_REQUESTS = ["<i8", "<u8", "<i8", "<i4", "<i1"]  # document, anchor, start, length, hot
_U = np.uint64


def with_refs(df: DataFrame, text: str, doc_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ref) and kept columns, named keep0 and so on: refs order documents as their ids do.

    Where ids are unique and none is null they are the refs.  Else documents are ordered by id (null first), then by their text's digest,
    and rows equal in both are one document that was read several times.
    """
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)))
    n, ids = df.select(F.col(doc_id).cast("long").alias("i")).agg(F.count("*"), F.count_distinct("i")).first()
    if n == ids:
        return base.withColumn("ref", F.col("doc_id"))
    base = base.withColumn("digest", F.sha2("text", 256))
    spark = df.sparkSession
    ranked = base.select("doc_id", "digest").distinct().sort("doc_id", "digest").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    schema = T.StructType([T.StructField("_i", T.LongType()), T.StructField("_d", T.StringType()), T.StructField("ref", T.LongType())])
    refs = stage_boundary(spark.createDataFrame(ranked, schema))
    return base.join(refs, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d"))).select("doc_id", "text", "ref", *(f"keep{k}" for k in range(len(keep))))


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(x.astype(_U)) >> _U(33)) % _U(parts)).astype(np.int32)


def _collapse(a: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted by anchor, context and place, one record per place; which are the first of their context; which begin an anchor."""
    order = np.lexsort((a[3], a[2], a[1], a[0]))
    a = [c[order] for c in a]
    context = np.ones(len(order), bool)
    context[1:] = (a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1])
    again = np.zeros(len(order), bool)
    again[1:] = ~context[1:] & (a[2][1:] == a[2][:-1]) & (a[3][1:] == a[3][:-1])
    a, context = [c[~again] for c in a], context[~again]
    anchor = np.ones(len(context), bool)
    anchor[1:] = a[0][1:] != a[0][:-1]
    return a, context, anchor


def _spans(a: list[np.ndarray], which: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    ref, start = a[2][which], a[3][which].astype(np.int64)
    yield from deal(1, _part(ref, parts), [ref, start, start + a[4][which]])


def find_anchors(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Each document's contexts by anchor; those that a mapper has seen earlier go on as spans to remove."""

    def partition(batches: Iterator[pa.RecordBatch]):
        held: list[list[np.ndarray]] = []

        def flush():
            a, context, _ = _collapse([np.concatenate(c) for c in zip(*held, strict=True)])
            held.clear()
            yield from _spans(a, ~context, parts)
            keep = [c[context] for c in a]
            yield from deal(0, _part(keep[0], parts), keep)

        for b in batches:
            refs = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_blocks(b.column(1)):
                if len(data) < width:
                    continue
                grams, place, first, last = anchored_places(data, offs, width, GRAM)
                doc = np.searchsorted(offs, first, side="right") - 1
                end = last + width
                marks = side_marks(grams, place, first, last, width, GRAM)
                held.append([grams[place], hash_spans(data, first, end), refs[i + doc], (first - offs[doc]).astype(np.int32), (end - first).astype(np.int32), *marks])
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return map_packed(docs, partition, "ref", "text")


def _met(group: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """True where another record of the group has the same mark; 0 is none."""
    some = np.flatnonzero(mark)
    both = (group[some].astype(_U) << _U(32)) | mark[some]
    order = np.argsort(both)
    both = both[order]
    equal = both[1:] == both[:-1]
    out = np.zeros(len(group), bool)
    out[some[order[1:][equal]]] = True
    out[some[order[:-1][equal]]] = True
    return out


def match_contexts(anchors: DataFrame, parts: int, hot: int) -> DataFrame:
    """Kind 1: spans of contexts whose whole bytes stand earlier.  Kind 2: one request per distinct context that may share a window with another one of its anchor.

    Such two agree in the bytes before the anchor or in those behind it, far enough for half a window (side_marks).
    """

    def partition(batches):
        found = blobs(batches)
        for part, blob in found.get(1, []):
            yield 1, part, blob
        if 0 not in found:
            return
        a, context, anchor = _collapse(unpack([b for _, b in found[0]], _ANCHORS))
        yield from _spans(a, ~context, parts)
        group = (np.cumsum(anchor) - 1)[context]
        several = np.bincount(group)[group] > 1
        a, group = [c[context][several] for c in a], group[several]
        ask = _met(group, a[5]) | _met(group, a[6])
        a, group = [c[ask] for c in a], group[ask]
        yield from deal(2, _part(a[2], parts), [a[2], a[0], a[3].astype(np.int64), a[4], (np.bincount(group)[group] > hot).astype(np.int8)])

    return map_packed(anchors, partition)


def by_document(packed: DataFrame, kind: int, kinds: list[str], parts: int) -> DataFrame:
    """(ref, blob): each document's records of a kind, without the document."""

    def partition(batches):
        own = blobs(batches).get(kind, [])
        if not own:
            return
        cols = unpack([b for _, b in own], kinds)
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        cuts = np.concatenate(([0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, [len(order)]))
        for lot in range(0, len(cuts) - 1, 4096):
            pairs = list(zip(cuts[lot : lot + 4096], cuts[lot + 1 : lot + 4097], strict=False))
            yield {"ref": cols[0][[s for s, _ in pairs]], "blob": [pack([c[s:e] for c in cols[1:]]) for s, e in pairs]}

    return map_partition(exchange(packed.where(F.col("kind") == kind), parts), "ref long, blob binary", partition)


def extract_contexts(docs: DataFrame, requests: DataFrame, width: int, parts: int) -> DataFrame:
    """The bytes of each asked context, dealt by anchor.

    Contexts of a hot anchor are cut further, wherever one of three more anchors of their windows changes: equal windows still meet.
    """
    joined = docs.join(requests, "ref").select("ref", "text", "blob")

    def partition(batches):
        held, size = [], 0

        def flush():
            key, ref, start, length, text = ([np.concatenate(c) for c in zip(*held, strict=True)])
            held.clear()
            part = _part(key, parts)
            order = np.argsort(part, kind="stable")
            at = np.concatenate(([0], np.cumsum(length.astype(np.int64))))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[s:e]
                body = np.concatenate([text[at[i] : at[i + 1]] for i in o])
                yield 3, int(part[o[0]]), np.int64(len(o)).tobytes() + pack([key[o], ref[o], start[o], length[o], body])

        for b in batches:
            data, offs = buffers(b.column(1))
            for d, (ref, blob) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = data[offs[d] : offs[d + 1]]
                key, start, length, hot = unpack([blob], _REQUESTS[1:])
                if hot.any():
                    lots = [_refine(own, key[i], start[i], length[i], width) for i in np.flatnonzero(hot)]
                    cold = hot == 0
                    key = np.concatenate([key[cold], *[x[0] for x in lots]])
                    start = np.concatenate([start[cold], *[x[1] for x in lots]])
                    length = np.concatenate([length[cold], *[x[2] for x in lots]]).astype(np.int32)
                body = own[_ranges(start, length)]
                held.append([key, np.full(len(key), ref), start, length, body])
                size += len(body) + 30 * len(key)
                if size > 16 << 20:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return map_packed(joined, partition)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    length = length.astype(np.int64)
    total = np.cumsum(length)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - np.concatenate(([0], total[:-1])), length) if len(total) else np.zeros(0, np.int64)


def _refine(own: np.ndarray, key: np.uint64, start: int, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = own[start : start + length]
    n = len(data) - width + 1
    finer = np.full(n, key)
    for seed in (1, 2, 3):
        k, first, last = anchored_runs(data, np.array([0, len(data)]), width, GRAM, seed)
        finer = mix64(finer * _U(3) + np.repeat(k, last - first + 1))
    first = np.flatnonzero(np.concatenate(([True], finer[1:] != finer[:-1])))
    last = np.append(first[1:], n) - 1
    return finer[first], start + first, last - first + width


def shard_spans(key: np.ndarray, ref: np.ndarray, start: np.ndarray, length: np.ndarray, body: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one shard's windows that stand earlier in the shard, by its suffix array and permuted common prefixes."""
    length = length.astype(np.int64)
    at = np.concatenate(([0], np.cumsum(length)))
    n = len(body)
    sa = suffix_array(body, 256)
    common = permuted_prefixes(body, sa)[sa]
    context = np.repeat(np.arange(len(length)), length)
    inside = np.arange(n) - at[context]
    owned = inside <= length[context] - width  # its window ends inside its context
    group = np.cumsum(common < width)  # suffixes with equal windows are neighbours
    keep = owned[sa]
    place, group = sa[keep], group[keep]
    keep = np.zeros(len(place), bool)  # windows that stand once are left out before they are ordered
    keep[1:] = group[1:] == group[:-1]
    keep[:-1] |= keep[1:]
    place, group = place[keep], group[keep]
    doc, pos = ref[context[place]], start[context[place]] + inside[place]
    order = np.lexsort((pos, doc, group))
    group, doc, pos = group[order], doc[order], pos[order]
    later = np.zeros(len(order), bool)
    later[1:] = (group[1:] == group[:-1]) & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))
    # The first place of a group stays, also where it was read twice.
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    first = np.repeat(head, np.diff(np.append(head, len(group))))
    later &= (doc != doc[first]) | (pos != pos[first])
    return merge_spans(doc[later], pos[later], pos[later] + width)


def merge_spans(ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each document; touching ones join."""
    if not len(ref):
        return ref, start, end
    order = np.lexsort((start, ref))
    ref, start, end = ref[order], start[order], end[order]
    change = np.concatenate(([True], ref[1:] != ref[:-1]))
    group = np.cumsum(change) - 1
    wide = np.int64(int(end.max()) + 1)
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    fresh = change.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return ref[first], start[first], reach[np.append(first[1:], len(ref)) - 1]


def sort_shards(contexts: DataFrame, width: int, parts: int, shard_bytes: int) -> DataFrame:
    """Suffix arrays of bounded shards; an anchor's contexts are never parted."""

    def partition(batches):
        lots = []
        for _, blob in blobs(batches).get(3, []):
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            cols, at = [], 8
            for kind in ("<u8", "<i8", "<i8", "<i4"):
                cols.append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
            lots.append((*cols, np.frombuffer(blob, np.uint8, offset=at)))
        if not lots:
            return
        key, ref, start, length, body = (np.concatenate(c) for c in zip(*lots, strict=True))
        lots.clear()
        at = np.concatenate(([0], np.cumsum(length.astype(np.int64))))
        order = np.argsort(key, kind="stable")
        total = np.cumsum(length[order].astype(np.int64))
        fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        heads = np.flatnonzero(fresh)
        base, cuts = 0, [0]
        for h in heads[1:]:
            if total[h - 1] - base >= shard_bytes:
                base = total[h - 1]
                cuts.append(int(h))
        cuts.append(len(order))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            o = order[s:e]
            text = body[_ranges(at[o], length[o])]
            doc, a, z = shard_spans(key[o], ref[o], start[o], length[o], text, width)
            yield from deal(1, _part(doc, parts), [doc, a, z])

    return map_packed(exchange(contexts, parts), partition)


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 100, shard_bytes: int = SHARD_BYTES, hot: int = HOT, kept: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts earlier (a smaller id, or the same document and an earlier start).

    Texts are whole and judged as they came in; matches never cross documents.

    1. Every window of ``width`` bytes has an anchor that depends on its bytes alone.  A document's windows of one anchor form a context.
    2. Contexts meet by anchor.  Equal ones are collapsed to the earliest, first in each mapper and then in each part; the others' bytes go.
    3. Distinct contexts of an anchor go to shards if another one has the same bytes before the anchor or behind it, over half a window: others
       can't share a window.  Each shard's suffix array is made by induced sorting, and its permuted common prefixes tell which windows stand
       in another context, or earlier in their own.
    4. A document's spans are merged and cut out.

    Returns per input row doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, and ``spans``).
    Null and empty texts and those shorter than ``width`` keep all their bytes.  Rows of equal id and text count as one document and each get its result;
    equal ids with different texts are ordered by digest; null ids come first.  Further columns are ignored; an empty table gives no rows.
    """
    parts = parts_of(df)
    docs = with_refs(df, text, doc_id)
    anchors = exchange(find_anchors(docs, width, parts), parts)
    matched = stage_boundary(match_contexts(anchors, parts, hot), release=True)
    requests = by_document(matched, 2, _REQUESTS, parts)
    shards = sort_shards(extract_contexts(docs, requests, width, parts), width, parts, shard_bytes)
    spans = by_document(matched.where("kind = 1").unionByName(shards), 1, _SPANS, parts)
    spans = stage_boundary(spans, release=True)

    def batch(b):
        data, offs = buffers(b.column(1))
        rows = []
        for d, blob in enumerate(b.column(2).to_pylist()):
            own = data[offs[d] : offs[d + 1]]
            start, end = unpack([blob], _SPANS[1:]) if blob else (np.zeros(0, np.int64),) * 2
            _, start, end = merge_spans(np.zeros(len(start), np.int64), start, end)
            stay = np.ones(len(own), bool)
            stay[_ranges(start, end - start)] = False
            rest = own[stay].tobytes()
            rows.append((len(own), len(own) - len(rest), len(start), hashlib.sha256(rest).hexdigest()) + ((rest, [{"start": int(s), "end": int(e)} for s, e in zip(start, end, strict=True)]) if kept else ()))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * kept
        yield {"doc_id": b.column(0)} | dict(zip(names, zip(*rows, strict=True), strict=True))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, end: long>>" * kept
    return map_batches(docs.join(spans, "ref", "left").select("doc_id", "text", "blob"), schema, batch)
