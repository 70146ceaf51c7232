"""Near-duplicate grouping by b-bit MinHash."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage_boundary
from ._arrow import map_batches, map_partition
from ._components import components
from ._kernel import mix64
from ._packed import parts_of
from .jaccard_join import _renumbered, _sets, compare_cells, fitting, join_few, join_text, lay_out_cells, verify_pairs
from .substring_dedup import with_refs

_U = np.uint64
#: Bands and rows of the minima that propose candidates: a pair at a similarity of 0.85 shares none of the bands with a probability of 4e-7.
BANDS, ROWS = 25, 5
#: Minima of a signature and the low bits of each that are kept; sixteen to a 64-bit word.
MINIMA, BITS = 128, 4
WORDS = MINIMA * BITS // 64
#: Chance that two different minima agree in their low bits.
BY_CHANCE = 2.0**-BITS
#: Chance with which the estimate may turn away a pair at the threshold.
MISS = 1e-9
#: Documents of one block of a bucket; blocks are compared two by two.
BLOCK = 4096
#: Lowest bit of each kept part of a word.
_LOWEST = _U(int("1" * (64 // BITS), 16))
#: Multipliers and shifts of the hash functions, odd and mixed from their numbers.
_TIMES = mix64(np.arange(1, MINIMA + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_PLUS = mix64(np.arange(1, MINIMA + 1, dtype=_U) + _U(0xD1B54A32D192ED03))


def signatures(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signatures, band keys) of sets that begin at starts; keys are hashes, so a multiplication orders them anew."""
    minima = np.empty((len(starts), MINIMA), _U)
    for k in range(MINIMA):
        minima[:, k] = np.minimum.reduceat(keys * _TIMES[k] + _PLUS[k], starts)
    low = (minima & _U(15)).astype(np.uint8)
    packed = np.ascontiguousarray(low[:, 0::2] | (low[:, 1::2] << 4)).view("<u8")
    bands = np.empty((len(starts), BANDS), _U)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, _U)
        for r in range(ROWS):
            key = mix64(key * _U(31) + minima[:, b * ROWS + r])
        bands[:, b] = key
    return packed, bands


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima whose kept bits differ, of packed signatures along the last axis: a bit count per word."""
    x = a ^ b
    x |= x >> _U(2)
    x |= x >> _U(1)
    return np.bitwise_count(x & _LOWEST).sum(axis=-1, dtype=np.int64)


def estimated(differ: np.ndarray) -> np.ndarray:
    """Similarity estimated from differing minima, corrected for those that agree by chance."""
    return (1 - differ / MINIMA - BY_CHANCE) / (1 - BY_CHANCE)


def most_differing(percent: int) -> int:
    """Differing minima up to which a pair is looked at: one at the threshold has more with a probability below MISS (Chernoff's bound)."""
    p = (1 - percent / 100) * (1 - BY_CHANCE)
    for m in range(math.ceil(p * MINIMA), MINIMA):
        q = m / MINIMA
        if p == 0 or (q > p and MINIMA * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))) >= -math.log(MISS)):
            return m
    return MINIMA


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """(ref, n, class, sig, bands): size and hash of each document's set, packed signature and band keys; null without words."""

    def batch(b):
        refs = b.column(0).to_numpy(zero_copy_only=False)
        for i, keys, doc, n_words in _sets(b.column(1), shingle):
            size = np.bincount(doc, minlength=len(n_words))
            some = np.flatnonzero(size)
            whole = np.zeros(len(size), _U)
            at = np.full(len(size), -1)
            at[some] = np.arange(len(some))
            missing = pa.array(np.where(at < 0, 0, at), mask=at < 0)
            sig, bands = pa.nulls(len(size), pa.binary()), pa.nulls(len(size), pa.list_(pa.int64()))
            if len(some):
                starts = np.concatenate(([0], np.cumsum(size[some])))[:-1]
                whole[some] = mix64(np.add.reduceat(mix64(keys ^ _U(0xA0761D6478BD642F)), starts) + size[some].astype(_U))
                packed, own = signatures(keys, starts)
                sig = pa.array([x.tobytes() for x in packed], pa.binary()).take(missing)
                bands = pa.ListArray.from_arrays(np.arange(0, own.size + 1, BANDS, dtype=np.int32), pa.array(own.view(np.int64).ravel())).take(missing)
            yield {"ref": refs[i : i + len(size)], "n": size.astype(np.int64), "class": whole.view(np.int64), "sig": sig, "bands": bands}

    return map_batches(docs, "ref long, n long, class long, sig binary, bands array<long>", batch, "ref", "text")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, lead, m, rep) of all classes in buckets of several: a bucket's first class and its classes."""
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("lead")).where("m > 1")
    return keys.join(buckets, "key").select("key", "lead", "m", "rep")


def similar_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those of fitting sizes whose estimate allows a link."""
    most = most_differing(percent)
    side = lambda name, n, sig: classes.select(F.col("rep").alias(name), F.col("n").alias(n), F.col("sig").alias(sig))
    rows = pairs.join(side("a", "m", "_a"), "a").join(side("b", "n", "_b"), "b").where(fitting(percent))

    def batch(b):
        one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u8").reshape(-1, WORDS) for i in (2, 3))
        keep = np.flatnonzero(differing(one, two) <= most)
        yield {"a": b.column(0).take(pa.array(keep)), "b": b.column(1).take(pa.array(keep))}

    return map_batches(rows, "a long, b long", batch, "a", "b", "_a", "_b")


def open_members(members: DataFrame, known: DataFrame) -> DataFrame:
    """(key, rep, label, stray): the classes, but leaders, of buckets in which they are in several components.

    Leaders have met all of their bucket.  What is in the leader's component needn't meet its like; strays meet all.
    """
    label = lambda name, out: known.select(F.col("node").alias(name), F.col("root").alias(out))
    rows = members.where("m > 2").join(label("rep", "_r"), "rep", "left").join(label("lead", "_l"), "lead", "left")
    rows = rows.select("key", "rep", F.coalesce("_r", "rep").alias("label"), F.coalesce("_l", "lead").alias("home"), (F.col("rep") == F.col("lead")).alias("leads")).where("NOT leads")
    rows = stage_boundary(rows)
    several = rows.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).where("_a <> _z").select("key")
    return rows.join(several, "key", "left_semi").select("key", "rep", "label", (F.col("label") != F.col("home")).alias("stray"))


def lay_out_blocks(opened: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, i, j, side, rep, label, n, sig): strays of a bucket in blocks i, against its classes in blocks j.

    Side 0: a stray that meets what follows it; 1: one that is met; 2: a class of the leader's component.
    """
    sizes = opened.groupBy("key").agg(F.count_if("stray").alias("_s"), F.count("*").alias("_m"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = stage_boundary(sizes.select("key", blocks("_s").alias("ns"), blocks("_m").alias("nm")))
    rows = join_few(opened, sizes, "key", "rep")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    asks = rows.where("stray").withColumn("i", block("ns")).withColumn("j", spread("nm")).withColumn("side", F.lit(0))
    met = rows.withColumn("j", block("nm")).withColumn("i", spread("ns")).withColumn("side", F.when(F.col("stray"), 1).otherwise(2))
    return asks.unionByName(met).select("key", "i", "j", "side", "rep", "label").join(classes.select("rep", "n", "sig"), "rep")


def forest(ask: np.ndarray, met: np.ndarray, ref: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int, most: int) -> list[tuple[int, int]]:
    """Edges that tie together all whose estimates allow a link, of a cell's classes in different components: fewer edges than classes."""
    tree = np.unique(ref, return_inverse=True)[1]
    out = []
    for x in ask.tolist():
        y = met[(label[met] != label[x]) & (100 * n[met] >= percent * n[x]) & (100 * n[x] >= percent * n[met])]
        y = y[differing(sig[y], sig[x][None]) <= most]
        y = y[tree[y] != tree[x]]
        if len(y):
            joined, first = np.unique(tree[y], return_index=True)
            out += [(int(ref[x]), int(ref[z])) for z in y[first].tolist()]
            joined = np.append(joined, tree[x])
            tree[np.isin(tree, joined)] = joined.min()
    return out


def tie_cells(cells: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): a forest of each cell's classes that may link.  A task holds one cell's signatures."""
    most = most_differing(percent)
    place = ["key", "i", "j"]
    rows = cells.select(*place, "side", "rep", "label", "n", "sig").repartition(parts, *place).sortWithinPartitions(*place)

    def partition(batches):
        now, held = None, []

        def closed():
            cols = [np.concatenate([h[k] for h in held]) for k in range(5)]
            held.clear()
            side, ref, label, n, sig = cols
            edges = forest(np.flatnonzero(side == 0), np.flatnonzero(side != 0), ref, label, n, sig, percent, most)
            if edges:
                yield dict(zip(("a", "b"), zip(*edges, strict=True), strict=True))

        for b in batches:
            key, i, j, side, ref, label, n = (b.column(c).to_numpy(zero_copy_only=False) for c in range(7))
            sig = np.frombuffer(b"".join(b.column(7).to_pylist()), "<u8").reshape(-1, WORDS)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(key)).tolist(), strict=True):
                cell = (key[s], i[s], j[s])
                if held and cell != now:
                    yield from closed()
                now = cell
                held.append([c[s:e] for c in (side, ref, label, n, sig)])
        if held:
            yield from closed()

    return map_partition(rows, "a long, b long", partition)


def find_links(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ref, n, class) of documents, (class, rep, n, sig, bands) of sets that aren't empty, and links (a, b) of classes' documents; steps 1 to 4 below."""
    parts = parts_of(docs)
    described = stage_boundary(describe(docs, shingle), release=True)
    meta = described.select("ref", "n", "class").distinct()
    classes = described.where("n > 0").groupBy("class").agg(F.min("ref").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sig", "bands")))
    classes = stage_boundary(classes)
    members = stage_boundary(bucket_members(classes))
    pairs = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = stage_boundary(similar_enough(pairs, classes, percent))
    links = stage_boundary(verify_pairs(docs, pairs, shingle, percent, parts), release=True)
    known = stage_boundary(components(links))
    opened = stage_boundary(open_members(members, known))
    ties = stage_boundary(tie_cells(lay_out_blocks(opened, classes), percent, parts))
    families = components(ties).select(F.col("node").alias("rep"), F.col("root").alias("gid"))
    left = families.join(classes.select("rep", "n"), "rep").join(known, F.col("rep") == F.col("node"), "left")
    left = stage_boundary(left.select(F.col("rep").alias("ref"), "n", "gid", F.coalesce("root", "rep").alias("known")))
    cells = stage_boundary(lay_out_cells(left))
    more = compare_cells(join_text(docs.select("ref", "text"), cells), shingle, percent, parts)
    return meta, classes, stage_boundary(links.unionByName(more).distinct(), release=True)


def minhash_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 85) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more, by b-bit MinHash.

    A set: distinct runs of ``shingle`` words of the lower-cased text (A-Z only); the whole sequence for fewer words; nothing, and no link, without words.

    1. A document's 128 minima give the keys of 25 bands of 5, and 4 low bits of each, packed in 64 bytes.  Documents of equal sets are one class.
    2. Classes of one band key are a bucket.  Each is estimated against the bucket's first: packed signatures are compared by a bit count, and the
       share of agreeing parts is corrected for those that agree by chance.  Pairs whose estimate allows a link are confirmed on full sets.
    3. In buckets whose other classes aren't in one component yet, strays are estimated against all, block by block in memory; of the
       pairs that may link only a forest is kept, whose trees are families.
    4. Families are compared on full sets, component against component, block by block in memory; only spanning links come out.
    5. Links of both steps make the components.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id).  Each link is
    confirmed, none is made by an estimate; one at the threshold is missed with a probability of 4e-7 (no shared band) at 0.85, one above it with less,
    unless others tie its documents together.  No bucket, family or number of candidates is capped.
    Null texts are empty.  Texts of any length are read whole.  Rows of equal id and text are one document, each returned; null ids get a component_id of the
    smallest id beside them, null if there is none, and are kept only then.  Further columns are ignored; an empty table gives no rows.
    """
    docs = with_refs(df, text, doc_id)
    meta, classes, links = find_links(docs, shingle, percent)
    table = classes.select("class", "rep").join(components(links), F.col("rep") == F.col("node"), "left").select("class", F.coalesce("root", "rep").alias("root"))
    result = docs.select("doc_id", "ref").join(meta, "ref").join(table, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "ref").alias("root"))
    if _renumbered(docs):
        result = result.join(result.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    else:
        result = result.withColumnRenamed("root", "component_id")
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
