"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage_boundary
from ._arrow import map_batches
from ._components import components
from ._kernel import LOWER, NOT_SPACE, buffers, hash_eights, hash_spans, mix64, string_column, text_blocks, unique_by_group
from ._packed import blobs, deal, exchange, map_packed, parts_of, unpack
from .jaccard_join import LOT, _rows, compare_cells, join_text, lay_out_cells, star_links, verify_pairs
from .substring_dedup import _ranges, by_document, with_refs

_U = np.uint64
#: Bands and rows of a signature: a pair at the threshold of 0.8 shares a band with probability 0.998, one at 0.9 with over 0.99999.
#: Rows keep unrelated lines apart: at a similarity of 0.05 one pair in three million shares a band.
BANDS, ROWS = 20, 6
#: Bytes of a shingle; a shorter line is one shingle.
SHINGLE = 8
#: Bytes of white space that are cut off lines one by one; where there are more, a block's solid bytes are searched.
TRIMS = 32
#: Tries by which empty bins look for a filled one together; after those each of the rest is looked up by itself.
TRIES = 12


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that isn't blank: its start, and start and end without outer white space; its document."""
    cuts = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate((offsets[:-1], cuts + 1))), np.sort(np.concatenate((cuts, offsets[1:])))
    filled = starts < ends
    starts, ends = starts[filled], ends[filled]
    a, z = starts.copy(), ends.copy()
    left, right = np.arange(len(a)), np.arange(len(a))
    for _ in range(TRIMS):
        left, right = left[~NOT_SPACE[data[a[left]]]], right[~NOT_SPACE[data[z[right] - 1]]]
        a[left] += 1
        z[right] -= 1
        left, right = left[a[left] < ends[left]], right[z[right] > starts[right]]
        if not len(left) and not len(right):
            break
    rest = np.union1d(left, right)
    if len(rest):
        solid = np.flatnonzero(NOT_SPACE[data])
        first, last = np.searchsorted(solid, starts[rest]), np.searchsorted(solid, ends[rest]) - 1
        some = first <= last
        a[rest], z[rest] = ends[rest], starts[rest]
        a[rest[some]], z[rest[some]] = solid[first[some]], solid[last[some]] + 1
    keep = a < z
    starts, a, z = starts[keep], a[keep], z[keep]
    return starts, a, z, np.searchsorted(offsets, starts, side="right") - 1


def _grams(low: np.ndarray, a: np.ndarray, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle and its line."""
    count = np.maximum(z - a - k + 1, 1)
    at, line = _ranges(a, count), np.repeat(np.arange(len(a)), count)
    if k != 8:
        return hash_spans(low, at, np.minimum(at + k, z[line])), line
    out, short = hash_eights(low, at), np.flatnonzero(z - a < 8)
    out[(np.cumsum(count) - 1)[short]] = hash_spans(low, a[short], z[short])
    return out, line


@lru_cache(1)
def donors() -> tuple[np.ndarray, np.ndarray]:
    """The bins that each bin copies from, try by try (the first TRIES of them), and the try in which a bin first gets to each other one."""
    bins = BANDS * ROWS
    each, own = np.arange(bins, dtype=_U) * _U(977), np.arange(bins)
    tries, rank, attempt = [], np.zeros((bins, bins), np.int32), 0
    while not (rank > 0).all():
        attempt += 1
        to = (mix64(each + _U(attempt * 1_000_003)) % _U(bins)).astype(np.int64)
        rank[own, to] = np.where(rank[own, to] > 0, rank[own, to], attempt)
        if attempt <= TRIES:
            tries.append(to)
    return np.array(tries), rank


def signatures(gram: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash: each shingle falls into one bin and bins keep their least; empty ones copy the bin that a fixed sequence of tries first finds filled."""
    bins = BANDS * ROWS
    sig = np.full(n * bins, 0xFFFFFFFF, np.uint32)
    where = gram >> _U(32)
    where *= _U(bins)
    where >>= _U(32)
    where += line.view(_U) * _U(bins)
    np.minimum.at(sig, where.view(np.int64), gram.astype(np.uint32) & np.uint32(0x7FFFFFFF))
    filled = sig != 0xFFFFFFFF
    grid, has = sig.reshape(n, bins), filled.reshape(n, bins)
    one = has.sum(axis=1) == 1
    grid[one] = grid[one].min(axis=1)[:, None]  # copies of the only one
    empty = np.flatnonzero(~(has | one[:, None]))
    own = empty % bins
    tries, rank = donors()
    for to in tries:
        donor = empty - own + to[own]
        ok = filled[donor]
        sig[empty[ok]] = sig[donor[ok]]
        empty, own = empty[~ok], own[~ok]
    for k in range(0, len(empty), 4096):
        line, bin_ = np.divmod(empty[k : k + 4096], bins)
        donor = np.where(has[line], rank[bin_], np.iinfo(np.int32).max).argmin(axis=1)
        grid[line, bin_] = grid[line, donor]
    return grid


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(sig), 1))
    for r in range(ROWS):
        key = mix64(key * _U(31) + sig[:, r::ROWS])
    return key


def describe_lines(docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """Kind 0: the first place of each line in a lot, as (hash, document, start, length).  Kind 2: its other places, (document, start).  Kind 1: (band's key, leading line, weight) of a mapper's lot.  Kind 6: links (leader, line) of a lot's bands."""

    def partition(batches):
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []
        places: list[list[np.ndarray]] = []

        def firsts():
            first, ref, start = one_place(*(np.concatenate(c) for c in zip(*places, strict=True)))
            places.clear()
            yield from deal(0, ((first[0] >> _U(17)) % _U(parts)).astype(np.int32), first)
            yield from deal(2, ((mix64(ref.astype(_U)) >> _U(33)) % _U(parts)).astype(np.int32), [ref, start])

        def flush():
            lead, links = star_links(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            yield from deal(1, ((lead[0] >> _U(17)) % _U(parts)).astype(np.int32), lead)
            yield from deal(6, ((links[1] >> _U(17)) % _U(parts)).astype(np.int32), links)

        for b in batches:
            refs = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_blocks(b.column(1)):
                low = LOWER[data]
                starts, a, z, doc = lines_of(low, offs)
                if not len(a):
                    continue
                h = hash_spans(low, a, z)
                places.append([h, refs[i + doc], starts - offs[doc], z - starts])
                if sum(len(x[0]) for x in places) > LOT:
                    yield from firsts()
                order = np.argsort(h)
                first = order[np.concatenate(([True], h[order[1:]] != h[order[:-1]]))]
                new = first[np.array([x not in seen for x in h[first].tolist()], bool)]
                if len(seen) > 1 << 19:
                    seen.clear()
                seen.update(h[new].tolist())
                if not len(new):
                    continue
                gram, line = _grams(low, a[new], z[new], shingle)
                keys = band_keys(signatures(gram, line, len(new)))
                held.append([keys.ravel(), np.repeat(h[new], BANDS)])
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield from flush()
        if held:
            yield from flush()
        if places:
            yield from firsts()

    return map_packed(docs, partition, "ref", "text")


def one_place(h: np.ndarray, ref: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each line's first place, and document and start of its other places; a place that was read twice is one."""
    order = np.lexsort((start, ref, h))
    h, ref, start, length = h[order], ref[order], start[order], length[order]
    same = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
    rest = same.copy()
    rest[1:] &= (ref[1:] != ref[:-1]) | (start[1:] != start[:-1])
    return [h[~same], ref[~same], start[~same], length[~same]], ref[rest], start[rest]


def first_places(described: DataFrame, parts: int) -> DataFrame:
    """Kind 0: each different line's first place, as (hash, document, start, length).  Kind 2: its other places, (document, start).
    Kind 6: links (leader, line) of bands, those of one lot and those between lots."""

    def partition(batches):
        own = blobs(batches)
        first, ref, start = one_place(*unpack([b for _, b in own.pop(0, [])], ["<u8", "<i8", "<i8", "<i8"]))
        yield from deal(0, ((first[0] >> _U(17)) % _U(parts)).astype(np.int32), first)
        yield from deal(2, ((mix64(ref.astype(_U)) >> _U(33)) % _U(parts)).astype(np.int32), [ref, start])
        _, links = star_links(*unpack([b for _, b in own.pop(1, [])], ["<u8", "<u8", "<i8"]))
        yield from deal(6, ((links[1] >> _U(17)) % _U(parts)).astype(np.int32), links)
        for kind in (2, 6):
            for part, blob in own.get(kind, []):
                yield kind, part, blob

    return map_packed(exchange(described, parts), partition)


def line_sets(column, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct character shingles of lines that stand one to a row."""
    for i, j, data, offs in text_blocks(column):
        low = LOWER[data]
        _, a, z, doc = lines_of(low, offs)
        gram, line = _grams(low, a, z, shingle) if len(a) else (np.zeros(0, _U), np.zeros(0, np.int64))
        keys, owner = unique_by_group(gram, doc[line] if len(a) else line)
        yield i, keys, owner, np.zeros(j - i, np.int64)


def line_texts(docs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(ref, text) of wanted lines, ref the line's hash.  wanted: (hash, ref, start, length), a place where it stands."""

    def to_packed(batches):
        for b in batches:
            h, ref, start, length = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            yield from deal(5, ((mix64(ref.astype(_U)) >> _U(33)) % _U(parts)).astype(np.int32), [ref, h, start, length])

    asked = by_document(map_packed(wanted, to_packed, "hash", "ref", "start", "length"), 5, ["<i8", "<i8", "<i8", "<i8"], parts)

    def batch(b):
        data, offs = buffers(b.column(0))
        refs, lines = [], []
        for d, blob in enumerate(b.column(1).to_pylist()):
            own = data[offs[d] : offs[d + 1]].tobytes()
            h, start, length = unpack([blob], ["<i8", "<i8", "<i8"])
            refs.append(h)
            lines += [own[s : s + n].decode("utf-8", "replace") for s, n in zip(start.tolist(), length.tolist(), strict=True)]
        yield {"ref": np.concatenate(refs), "text": lines}

    return map_batches(join_text(docs, stage_boundary(asked)), "ref long, text string", batch, "text", "blob")


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep one line of each component of similar lines, the first one (smallest id, earliest place).

    Lines are compared in lower case (A-Z) and without outer white space; blank ones are kept and never compared.  Lines are similar whose sets of
    ``shingle``-byte shingles have a Jaccard similarity of percent / 100 or more (a shorter line is one shingle).

    1. Equal lines are one.  Different ones get signatures, and those that share a band are candidates.
    2. Each candidate is verified with its band's leading line; verified links are joined to components.
    3. Lines that bands tie together and that are still in different components are all compared in memory, so no candidate link is lost.
    4. Components by distributed union-find; all lines but each component's first are cut out, with their line break.

    Returns per input row doc_id, n_lines (not blank), n_removed, kept (the remaining text) and the columns named by ``keep``.  Null texts are empty.  Rows of equal id and text are one document,
    each returned with the same result; equal ids of different texts are ordered by digest, null ids first.  Other columns are ignored; an empty table gives no rows.
    """
    parts = parts_of(df)
    docs = with_refs(df, text, doc_id, keep)
    described = stage_boundary(first_places(describe_lines(docs, shingle, parts), parts), release=True)
    firsts = _rows(described, 0, "hash long, ref long, start long, length long", ["<u8", "<i8", "<i8", "<i8"], None)
    later = _rows(described, 2, "ref long, start long", ["<i8", "<i8"], None)
    stars = stage_boundary(_rows(described, 6, "leader long, class long", ["<u8", "<u8"], None).distinct())
    wanted = firsts.join(stars.select(F.explode(F.array("leader", "class")).alias("hash")).distinct(), "hash").select("hash", "ref", "start", "length")
    candidates = stage_boundary(line_texts(docs.select("ref", "text"), wanted, parts), release=True)
    links = stage_boundary(verify_pairs(candidates, stars.select(F.col("leader").alias("a"), F.col("class").alias("b")), shingle, percent, parts, line_sets))
    known, family = components(links), components(stars, "leader", "class").select(F.col("node").alias("ref"), F.col("root").alias("gid"))
    reps = family.join(known, F.col("ref") == F.col("node"), "left").join(firsts.select(F.col("hash").alias("ref"), F.col("length").alias("n")), "ref")
    reps = stage_boundary(reps.select("ref", "n", "gid", F.coalesce("root", "ref").alias("known")))
    more = compare_cells(join_text(candidates, stage_boundary(lay_out_cells(reps))), shingle, percent, parts, line_sets)
    roots = components(stage_boundary(links.unionByName(more)))
    member = firsts.join(roots, F.col("hash") == F.col("node")).select("root", F.struct("ref", "start").alias("place"))
    keeper = member.groupBy("root").agg(F.min("place").alias("keep"))
    lost = member.join(keeper, "root").where("place <> keep").select("place.ref", "place.start")
    drops = later.unionByName(lost).groupBy("ref").agg(F.sort_array(F.collect_set("start")).alias("drops"))
    drops = stage_boundary(drops, release=True)
    joined = docs.join(drops, "ref", "left")

    def batch(b):
        column = string_column(b.column(1))
        n = np.zeros(len(column), np.int64)
        for i, j, data, offs in text_blocks(column):
            n[i:j] = np.bincount(lines_of(data, offs)[3], minlength=j - i)
        drop = b.column(2).to_pylist()
        some = [d for d, x in enumerate(drop) if x]
        kept = column
        if some:
            mask = np.zeros(len(column), bool)
            mask[some] = True
            kept = pc.replace_with_mask(column, pa.array(mask), pa.array([cut_lines(column[d].as_py(), drop[d]) for d in some], column.type))
        yield {"doc": b.column(0), "n_lines": n, "n_removed": [len(x or ()) for x in drop], "kept": kept} | {x: b.column(3 + k) for k, x in enumerate(names)}

    names, kinds = [f"keep{k}" for k in range(len(keep))], dict(df.dtypes)
    schema = "doc long, n_lines long, n_removed long, kept string" + "".join(f", {x} {kinds[c]}" for x, c in zip(names, keep, strict=True))
    out = map_batches(joined.select("doc_id", "text", "drops", *names), schema, batch)
    own = [] if "doc_id" in keep else [F.col("doc").alias("doc_id")]
    return out.select(*own, "n_lines", "n_removed", "kept", *(F.col(x).alias(c) for x, c in zip(names, keep, strict=True)))


def cut_lines(text: str, starts: list[int]) -> str:
    """The text without the lines that begin at these byte offsets."""
    gone, at, out = set(starts), 0, []
    for line in text.encode().split(b"\n"):
        if at not in gone:
            out.append(line)
        at += len(line) + 1
    return b"\n".join(out).decode("utf-8", "replace")

