"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage_boundary
from ._arrow import map_partition
from ._components import components
from ._kernel import mix64, text_blocks, unique_by_group, word_shingles
from ._packed import blobs, deal, exchange, map_packed, pack, parts_of, unpack
from .substring_dedup import with_refs

_U = np.uint64
#: Bands and rows of the signatures that group documents; they only save work, the matrix finds every link.
BANDS, ROWS = 8, 5
#: Documents and tokens of one block of a group; blocks are compared two by two, each pair in one task's memory.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 20
#: Counters of the sketch of token frequencies, 8 MB in all; it only orders tokens, so it changes no result.
SKETCH_BITS = 20
#: A token's documents in one mapper's lot from which on they are counted.
FREQUENT_IN_LOT = 8
#: Band records that a mapper holds before it joins those of equal keys.
LOT = 1 << 18
#: Marks by which band keys that stand once are told from the others, 1 MB of them.
OFTEN_BITS = 20
#: Extra share of a document's tokens in its prefix; so many of them must be met.
EXTRA = 0.05
#: Measured bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Pairs and tokens of a cell up to which its documents are compared two by two; matrices are dearer there.
FEW_PAIRS, FEW_TOKENS = 64, 1 << 13
#: Documents compared with one leader in a task.
CHUNK = 256
#: Parts of a key's rows where a join can't be broadcast.
SALTS = 32


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a table, whose rows and bytes are summed first, may be broadcast."""
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    long += [8 * F.coalesce(F.size(c), F.lit(0)) for c, kind in table.dtypes if kind.startswith("array")]
    size = F.lit(16 + 8 * len(table.columns)).cast("long")
    for x in long:
        size = size + x
    return (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def join_text(docs: DataFrame, table: DataFrame, on: str = "ref", how: str = "inner") -> DataFrame:
    """docs with table's columns; texts stay where they are if the table is small in bytes, and are shuffled else."""
    return docs.join(F.broadcast(table) if fits_broadcast(table) else table, on, how)


def join_few(rows: DataFrame, table: DataFrame, key: str, part: str = "ref") -> DataFrame:
    """rows with the columns of a table that has one row per key; a key with many rows is dealt over SALTS tasks, by the column part."""
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n shares with any set that it links with, at least."""
    return -(-n * percent // 100)


def linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _sets(column, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, keys, row of each key, words per row) by block of documents: distinct shingles."""
    for i, j, data, offs in text_blocks(column):
        keys, doc, n_words = word_shingles(data, offs, shingle)
        keys, doc = unique_by_group(keys, doc)
        yield i, keys, doc, n_words


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> _U(17)) % _U(parts)).astype(np.int32)


def often(key: np.ndarray) -> np.ndarray:
    """Marks all keys that stand more than once, and some of the others: those that agree with such a one in their upper bits.

    A sort of values alone takes a twentieth of one that orders records by key and class.
    """
    value = np.sort(key)
    mark = np.zeros(1 << OFTEN_BITS, bool)
    mark[value[1:][value[1:] == value[:-1]] >> _U(64 - OFTEN_BITS)] = True
    return mark[key >> _U(64 - OFTEN_BITS)]


def star_links(key: np.ndarray, h: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each key's leader, as (key, class, weight), and links (leader, class) to the key's other classes, each once.

    A class weighs as much as the classes that its keys are shared with: of many edited copies the common original keeps most of the shared keys,
    so it leads, and links with copies that don't link with each other.  Joining leaders of several lots again ties all classes of a key
    together, as they are in one list of a key at most as often as there are lots.  Most keys stand once: their one class leads them, and only the others
    are put in order.
    """
    shared = often(key)
    lone = [key[~shared], h[~shared]] + ([] if weight is None else [weight[~shared]])
    key, h, weight = key[shared], h[shared], None if weight is None else weight[shared]
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1]))) if len(key) else np.zeros(0, bool)
    weight = None if weight is None else np.maximum.reduceat(weight[order], np.flatnonzero(fresh)) if len(key) else weight
    key, h = key[fresh], h[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    m = np.diff(np.append(first, len(key)))
    if weight is None:
        own, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=np.repeat(m - 1, m)).astype(np.int64)
        weight = total[at]
        at = np.minimum(np.searchsorted(own, lone[1]), max(len(own) - 1, 0))
        lone.append(np.where(own[at] == lone[1], total[at], 0) if len(own) else np.zeros(len(lone[1]), np.int64))
    group = np.repeat(np.arange(len(first)), m)
    best = np.lexsort((h, weight, group))[np.cumsum(m) - 1]  # of each key the heaviest, of equal ones the largest
    leader = h[best]
    rest = leader[group] != h
    a, b = leader[group][rest], h[rest]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    lead = [np.concatenate(x) for x in zip(lone, [key[first], leader, weight[best]], strict=True)]
    return lead, [a[fresh], b[fresh]]


def sketch_counts(keys: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(counter, sum) of the counters that keys fall on."""
    at, inverse = np.unique((keys >> _U(64 - SKETCH_BITS)).astype(np.int32), return_inverse=True)
    return [at, np.bincount(inverse, weights=n).astype(np.int64)]


def describe_documents(docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """Kind 0: (document, set size, set's hash).  Kind 1: (band's key, leading class, weight) of a mapper's lot.  Kind 2: counts of tokens that a lot holds often.
    Kind 6: links (leader, class) of a lot's bands."""

    def partition(batches):
        held, tokens = [], []

        def lot():
            key, n = np.unique(np.concatenate(tokens), return_counts=True)
            tokens.clear()
            often = n >= FREQUENT_IN_LOT
            at, n = sketch_counts(key[often], n[often])
            yield from deal(2, (at.astype(np.int64) * parts >> SKETCH_BITS).astype(np.int32), [at, n])

        def bands():
            lead, links = star_links(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            yield from deal(1, _part(lead[0], parts), lead)
            yield from deal(6, _part(links[1], parts), links)

        for b in batches:
            refs = b.column(0).to_numpy(zero_copy_only=False)
            for i, keys, doc, n_words in _sets(b.column(1), shingle):
                size = np.bincount(doc, minlength=len(n_words))
                some = np.flatnonzero(size)
                ref = refs[i : i + len(size)]
                whole = np.zeros(len(size), _U)
                if len(some):
                    starts = np.concatenate(([0], np.cumsum(size[some])))[:-1]
                    whole[some] = mix64(np.add.reduceat(mix64(keys ^ _U(0xA0761D6478BD642F)), starts) + size[some].astype(_U))
                    for band in range(BANDS):
                        key = np.full(len(some), band + 1, _U)
                        for row in range(ROWS):
                            key = mix64(key * _U(31) + np.minimum.reduceat(mix64(keys + _U(0x9E3779B97F4A7C15 * (band * ROWS + row + 1) % (1 << 64))), starts))
                        held.append([key, whole[some]])
                yield from deal(0, _part(whole, parts), [ref, size.astype(np.int64), whole])
                tokens.append(keys)
                if sum(map(len, tokens)) > 1 << 21:
                    yield from lot()
                if sum(len(x[0]) for x in held) > LOT:
                    yield from bands()
        if tokens:
            yield from lot()
        if held:
            yield from bands()

    return map_packed(docs, partition, "ref", "text")


def _rows(packed: DataFrame, kind: int, schema: str, kinds: list[str], parts: int | None, reduce=None) -> DataFrame:
    """A packed kind's records as rows, those of a part first given to reduce."""
    names = [x.split()[0] for x in schema.split(", ")]

    def partition(batches):
        cols = unpack([b for _, b in blobs(batches).get(kind, [])], kinds)
        cols = reduce(cols) if reduce else cols
        for i in range(0, len(cols[0]), 1 << 17):
            yield {n: c[i : i + (1 << 17)].view(np.int64) if c.dtype == _U else c[i : i + (1 << 17)] for n, c in zip(names, cols, strict=True)}

    own = packed.where(F.col("kind") == kind)
    return map_partition(exchange(own, parts) if parts else own, schema, partition)


def band_links(described: DataFrame, parts: int) -> DataFrame:
    """(leader, class): a forest's links between classes that share a band, so that all of a band are in one tree."""
    across = _rows(described, 1, "leader long, class long", ["<u8", "<u8", "<i8"], parts, lambda cols: star_links(*cols)[1])
    within = _rows(described, 6, "leader long, class long", ["<u8", "<u8"], None)
    return within.unionByName(across).distinct()


def verify_pairs(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, parts: int, sets=None) -> DataFrame:
    """Of pairs (a, b) of documents' refs those whose sets link.

    b's text goes to a's task; the many partners of one a are dealt into chunks with a's text in each.  Only a's set and one block are in memory.
    """
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).cast("long")
    sets = sets or _sets
    counted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", chunk.alias("chunk"))
    counted = stage_boundary(counted)
    leaders = counted.select(F.col("a").alias("ref"), "a", "chunk").distinct()
    partners = counted.select(F.col("b").alias("ref"), "a", "chunk")
    text = lambda t, rank: join_text(docs, t).select("a", "chunk", F.lit(rank).alias("rank"), "ref", "text")
    rows = text(leaders, 0).unionByName(text(partners, 1)).repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", "rank")

    def partition(batches):
        now, mine = None, None
        for b in batches:
            a, chunk, rank, ref = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = []
            for i, keys, doc, n_words in sets(b.column(4), shingle):
                cuts = np.searchsorted(doc, np.arange(len(n_words) + 1))
                for d in range(len(n_words)):
                    own, k = keys[cuts[d] : cuts[d + 1]], i + d
                    if rank[k] == 0:
                        now, mine = (a[k], chunk[k]), own
                    elif now == (a[k], chunk[k]) and len(own) and len(mine):
                        small, large = (own, mine) if len(own) < len(mine) else (mine, own)
                        at = np.searchsorted(large, small)
                        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                        if linked(common, len(own), len(mine), percent):
                            out.append((a[k], ref[k]))
            if out:
                yield dict(zip(("a", "b"), zip(*out, strict=True), strict=True))

    return map_partition(rows, "a long, b long", partition)


def frequent_tokens(described: DataFrame, parts: int) -> np.ndarray:
    """Counters of token frequencies, by the tokens' upper bits: of a fixed size, whatever the corpus.  Used for an order alone."""

    def partition(batches):
        at, n = unpack([b for _, b in blobs(batches).get(2, [])], ["<i4", "<i8"])
        at, inverse = np.unique(at, return_inverse=True)
        yield 2, 0, pack([at, np.bincount(inverse, weights=n).astype(np.int64)])

    rows = map_packed(exchange(described.where(F.col("kind") == 2), parts), partition)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.select("blob").collect():  # 12 bytes a counter at most
        at, n = unpack([r.blob], ["<i4", "<i8"])
        out[at] = n
    return out


def prefix_extra(n: np.ndarray) -> np.ndarray:
    return 1 + (n * EXTRA).astype(np.int64)


def emit_prefixes(docs: DataFrame, frequent, shingle: int, percent: int, parts: int) -> DataFrame:
    """The token-group matrix's entries: each document's rarest tokens with its group and size."""

    def partition(batches):
        often = frequent.value
        held = []

        def flush():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            yield from deal(3, ((cols[0] >> _U(40)) % _U(parts)).astype(np.int32), [cols[0].astype(np.uint32), *cols[1:]])

        for b in batches:
            refs, groups = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for i, keys, doc, n_words in _sets(b.column(1), shingle):
                if not len(keys):
                    continue
                order = np.lexsort((keys, often[keys >> _U(64 - SKETCH_BITS)], doc))
                keys, doc = keys[order], doc[order]
                size = np.bincount(doc, minlength=len(n_words))
                first = np.concatenate(([0], np.cumsum(size)))[:-1]
                length = np.minimum(size, size - least_overlap(size, percent) + prefix_extra(size))
                keep = np.arange(len(keys)) - first[doc] < length[doc]
                d = doc[keep]
                held.append([keys[keep], refs[i + d], groups[i + d], size[d].astype(np.int32)])
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield from flush()
        if held:
            yield from flush()

    return map_packed(docs, partition, "ref", "text", "gid")


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    total = np.cumsum(length)
    return np.repeat(start - (total - length), length) + np.arange(int(total[-1]) if len(total) else 0)


def count_overlaps(matrix: DataFrame, percent: int, parts: int) -> DataFrame:
    """(query, group, tokens of the query's prefix in the group's token union), of groups of smaller number and members of fitting size.

    A token's list meets its groups, not its documents: a group counts once for a query, however many members hold the token.
    """

    def partition(batches):
        token, ref, gid, size = unpack([b for _, b in blobs(batches).get(3, [])], ["<u4", "<i8", "<i8", "<i4"])
        if not len(token):
            return
        order = np.lexsort((ref, gid, token))
        token, ref, gid, size = token[order], ref[order], gid[order], size[order].astype(np.int64)
        fresh = np.concatenate(([True], token[1:] != token[:-1]))
        head = np.flatnonzero(fresh | np.concatenate(([True], gid[1:] != gid[:-1])))  # of each group in each list
        least, most = np.minimum.reduceat(size, head), np.maximum.reduceat(size, head)
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(token))))
        begin = np.flatnonzero(fresh[head])
        base = np.repeat(begin, np.diff(np.append(begin, len(head))))  # first group of each group's list
        earlier = group - base[group]
        found: list[list[np.ndarray]] = []

        def counted():
            out = _sum_pairs([np.concatenate(c) for c in zip(*found, strict=True)])
            found.clear()
            return out

        asks = np.flatnonzero(earlier)
        total = np.cumsum(earlier[asks])
        at = 0
        while at < len(asks):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 22), side="right")))
            q = asks[at:stop]
            g = _spans(base[group[q]], earlier[q])
            q = np.repeat(q, earlier[q])
            fit = (100 * most[g] >= percent * size[q]) & (percent * least[g] <= 100 * size[q])
            q, g = q[fit], g[fit]
            found.append([ref[q], gid[head[g]], np.ones(len(q), np.int64)])
            if sum(len(x[0]) for x in found) > 1 << 21:
                found.append(counted())
            at = stop
        if found:
            q, g, n = counted()
            yield from deal(4, ((mix64(q.astype(_U)) >> _U(33)) % _U(parts)).astype(np.int32), [q, g, n])

    return map_packed(exchange(matrix, parts), partition)


def _sum_pairs(cols: list[np.ndarray]) -> list[np.ndarray]:
    q, g, n = cols
    if not len(q):
        return cols
    o = np.lexsort((g, q))
    q, g, n = q[o], g[o], n[o]
    at = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (g[1:] != g[:-1]))))
    return [q[at], g[at], np.add.reduceat(n, at)]


def find_links(docs: DataFrame, shingle: int, percent: int, counted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(ref, n, class) of documents, (class, rep, n) of sets that aren't empty, links (a, b) of classes' documents, and (rep, n_links); steps 1 to 4 below.

    The links tie together all that link, but are spanning; only where they are counted are all pairs of a group and of its queries compared.
    """
    parts = parts_of(docs)
    spark = docs.sparkSession
    described = stage_boundary(describe_documents(docs.select("ref", "text"), shingle, parts), release=True)
    meta = _rows(described, 0, "ref long, n long, class long", ["<i8", "<i8", "<u8"], None).distinct()
    classes = stage_boundary(meta.where("n > 0").groupBy("class").agg(F.min("ref").alias("rep"), F.first("n").alias("n")))
    stars = stage_boundary(band_links(described, parts))
    lead = classes.select(F.col("class").alias("leader"), F.col("rep").alias("a"), F.col("n").alias("m"))
    proposed = stars.join(classes, "class").join(lead, "leader").where(fitting(percent)).select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    links = stage_boundary(verify_pairs(docs, proposed, shingle, percent, parts), release=True)
    known, family = components(links), components(stars, "leader", "class")
    reps = classes.join(family, F.col("class") == F.col("node"), "left").select("rep", "n", F.coalesce("root", "class").alias("family"))
    named = reps.groupBy("family").agg(F.min("rep").alias("gid"))
    reps = reps.join(named, "family").join(known, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("ref"), "n", "gid", F.coalesce("root", "rep").alias("known"))
    reps = stage_boundary(reps)
    frequent = spark.sparkContext.broadcast(frequent_tokens(described, parts))
    matrix = emit_prefixes(join_text(docs, reps.select("ref", "gid")), frequent, shingle, percent, parts)
    bounds = _rows(stage_boundary(count_overlaps(matrix, percent, parts), release=True), 4, "query long, gid long, met long", ["<i8", "<i8", "<i8"], parts, _sum_pairs)
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) * EXTRA)
    own = reps.select(F.col("ref").alias("query"), "n", "known")
    opened = stage_boundary(bounds.join(own, "query").where(F.col("met") >= least).select("query", "gid", "n", "known"))
    more = compare_cells(join_text(docs, stage_boundary(lay_out_cells(reps, opened, counted))), shingle, percent, parts, counted=counted)
    if not counted:
        return meta, classes, stage_boundary(links.unionByName(more).distinct(), release=True), None
    more = stage_boundary(more, release=True)
    degree = more.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    return meta, classes, stage_boundary(links.unionByName(more.where("a <> b").select("a", "b")).distinct()), degree


def _block_count(docs: str, tokens: str):
    return F.greatest(F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(tokens) / BLOCK_TOKENS), F.lit(1)).cast("int")


def lay_out_cells(reps: DataFrame, opened: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(g, k, i, j, side, ref, known): which documents meet in which cell.

    A group's largest component is its home, its other members are strays.  k = 0: strays with each other, block i against block j >= i.  k = 2: strays,
    block i, against the home's members, block j, which never meet each other.  k = 1: queries that opened the group, block i, against its members, block j.
    Groups whose members are all linked with each other already need no cell of the first kinds; one stray costs each member one place.
    whole: every two members of a group meet, and every query each of them, once, so that links can be counted: all members are laid out as strays are.
    A group's number of blocks goes to its rows by a broadcast of checked size or by a salted join, so no group's rows meet in one task.
    """
    block = lambda n: F.pmod(F.xxhash64("ref"), F.col(n)).cast("int")
    each = reps.groupBy("gid", "known").agg(F.count("*").alias("_d"), F.sum("n").alias("_t"))
    groups = each.groupBy("gid").agg(F.sum("_d").alias("_d"), F.sum("_t").alias("_t"), F.max(F.struct("_d", "known", "_t")).alias("_h"))
    groups = groups.withColumn("_hd", F.col("_h._d")).withColumn("_ht", F.col("_h._t")).withColumn("_sd", F.col("_d") - F.col("_hd")).withColumn("_st", F.col("_t") - F.col("_ht"))
    strays = F.when(F.col("_sd") > 0, _block_count("_sd", "_st")).otherwise(0)
    if whole:
        strays = F.when(F.col("_d") > 1, _block_count("_d", "_t")).otherwise(0)
    groups = stage_boundary(groups.select("gid", _block_count("_d", "_t").alias("nb"), F.col("_h.known").alias("home"), strays.alias("ns"), _block_count("_hd", "_ht").alias("nh")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = lambda d, k, side: d.select(F.col("gid").alias("g"), F.lit(k).alias("k"), "i", "j", side.alias("side"), "ref", "known")
    split = join_few(reps, groups.where("ns > 0").select("gid", "home", "ns", "nh"), "gid")
    stray = (split if whole else split.where("known <> home")).withColumn("b", block("ns"))
    among = stray.withColumn("o", spread("ns")).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    own = cell(among, 0, F.when(F.col("b") <= F.col("o"), 0).otherwise(1))
    if not whole:
        own = own.unionByName(cell(stray.withColumn("i", F.col("b")).withColumn("j", spread("nh")), 2, F.lit(0)))
        own = own.unionByName(cell(split.where("known = home").withColumn("j", block("nh")).withColumn("i", spread("ns")), 2, F.lit(1)))
    if opened is None:
        return own
    asking = opened.groupBy("gid").agg(F.count("*").alias("_d"), F.sum("n").alias("_t")).withColumn("nq", _block_count("_d", "_t")).select("gid", "nq")
    sizes = stage_boundary(groups.select("gid", "nb").join(asking, "gid").select("gid", "nb", "nq"))
    queries = join_few(opened.withColumnRenamed("query", "ref"), sizes, "gid").withColumn("i", block("nq")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    members = join_few(reps, sizes, "gid").withColumn("j", block("nb")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    cross = [d.select(F.col("gid").alias("g"), F.lit(1).alias("k"), "i", "j", F.lit(side).alias("side"), "ref", "known") for side, d in ((0, queries), (1, members))]
    return own.unionByName(cross[0]).unionByName(cross[1])


def _few_links(sets: list[np.ndarray], pairs: list[tuple[int, int]], ref: np.ndarray, known: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """cell_links of these pairs, one after the other."""
    own, component = [set(x.tolist()) for x in sets], known.tolist()
    degree, out = np.zeros(len(sets), np.int64), []
    for p, q in pairs:
        if own[p] and own[q] and linked(len(own[p] & own[q]), len(own[p]), len(own[q]), percent):
            degree[p] += 1
            degree[q] += 1
            if component[p] != component[q]:
                out.append((int(ref[p]), int(ref[q])))
                low, high = sorted((component[p], component[q]))
                component = [low if x == high else x for x in component]
    return out, degree


def cell_links(sets: list[np.ndarray], side: np.ndarray, ref: np.ndarray, known: np.ndarray, percent: int, two: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between documents of different components in a cell: those of a spanning forest, so fewer than the cell has components; and each document's
    number of links in the cell, which are all of them.  two: documents meet those of the other side alone.

    Documents whose overlap with the other side's token union can't reach the bound are left out, until none is.
    """
    n = np.array([len(x) for x in sets], np.int64)
    if (int((side == 0).sum() * (side == 1).sum()) if two else len(sets) * (len(sets) - 1) // 2) <= FEW_PAIRS and n.sum() <= FEW_TOKENS:
        at = range(len(sets))
        return _few_links(sets, [(p, q) for p in at for q in at if (side[p] == 0 and side[q] == 1 if two else p < q)], ref, known, percent)
    degree = np.zeros(len(sets), np.int64)
    keep = np.flatnonzero(n)
    while True:
        if len(keep) < 2:
            return [], degree
        token = np.concatenate([sets[i] for i in keep])
        doc = np.repeat(np.arange(len(keep)), n[keep])
        _, at = np.unique(token, return_inverse=True)
        if two:
            left = np.bincount(at, weights=side[keep][doc] == 0)
            right = np.bincount(at) - left
            shared = np.where(side[keep][doc] == 0, right[at] > 0, left[at] > 0)
        else:
            shared = np.bincount(at)[at] > 1
        good = np.bincount(doc[shared], minlength=len(keep)) >= least_overlap(n[keep], percent)
        if good.all():
            break
        keep = keep[good]
    at, doc = at[shared], doc[shared]
    used, at = np.unique(at, return_inverse=True)
    rows = np.flatnonzero(side[keep] == 0)
    columns = np.flatnonzero(side[keep] == 1) if two else rows
    order = np.argsort(at, kind="stable")
    at, doc = at[order], doc[order]
    size, component, out = n[keep], known[keep].copy(), []
    for low in range(0, len(rows), 512):
        lot = rows[low : low + 512]
        common = np.zeros((len(lot), len(columns)), np.float32)
        place = np.full(len(keep), -1)
        place[lot] = np.arange(len(lot))
        other = np.full(len(keep), -1)
        other[columns] = np.arange(len(columns))
        for t in range(0, len(used), 2048):
            wide = min(2048, len(used) - t)
            a, z = np.searchsorted(at, (t, t + wide))
            d, c = doc[a:z], at[a:z] - t
            x = np.zeros((len(lot), wide), np.float32)
            mine = place[d] >= 0
            if not mine.any():
                continue
            x[place[d[mine]], c[mine]] = 1
            y = np.zeros((len(columns), wide), np.float32)
            theirs = other[d] >= 0
            y[other[d[theirs]], c[theirs]] = 1
            common += x @ y.T
        common = common.astype(np.int64)
        fits = 100 * common >= percent * (size[lot][:, None] + size[columns][None] - common)
        if two:
            degree[keep[columns]] += fits.sum(axis=0)
        else:
            fits[np.arange(len(lot)), low + np.arange(len(lot))] = False
        degree[keep[lot]] += fits.sum(axis=1)
        fits &= component[lot][:, None] != component[columns][None]
        for p, fit in zip(lot.tolist(), fits, strict=True):
            met = columns[fit & (component[columns] != component[p])]
            if len(met):
                joined, first = np.unique(component[met], return_index=True)
                out += [(int(ref[keep[p]]), int(ref[keep[q]])) for q in met[first].tolist()]
                joined = np.append(joined, component[p])
                component[np.isin(component, joined)] = joined.min()
    return out, degree


def compare_cells(cells: DataFrame, shingle: int, percent: int, parts: int, sets=None, counted: bool = False) -> DataFrame:
    """Links (a, b) of all cells; counted: (a, b, n), with n = 0, and (a, a, n) for a's number of links in a cell.

    A task holds one cell's sets at a time; texts are shipped, not sets, as they compress.
    """
    sets = sets or _sets
    key = ["g", "k", "i", "j"]
    rows = cells.select(*key, "side", "ref", "known", "text").repartition(parts, *key).sortWithinPartitions(*key)

    def partition(batches):
        now, held = None, []

        def closed():
            if len(held) > 1:
                own, side, ref, known = zip(*held, strict=True)
                links, degree = cell_links(list(own), np.array(side), np.array(ref), np.array(known), percent, now[1] != 0 or now[2] != now[3])
                if links:
                    yield dict(zip(("a", "b"), zip(*links, strict=True), strict=True)) | ({"n": [0] * len(links)} if counted else {})
                some = np.flatnonzero(degree)
                if counted and len(some):
                    yield {"a": np.array(ref)[some], "b": np.array(ref)[some], "n": degree[some]}
            held.clear()

        for b in batches:
            *place, side, ref, known = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            for i, keys, doc, n_words in sets(b.column(7), shingle):
                cuts = np.searchsorted(doc, np.arange(len(n_words) + 1))
                for d in range(len(n_words)):
                    cell = tuple(x[i + d] for x in place)
                    if cell != now:
                        yield from closed()
                        now = cell
                    held.append((keys[cuts[d] : cuts[d + 1]].copy(), side[i + d], ref[i + d], known[i + d]))
        yield from closed()

    return map_partition(rows, "a long, b long, n long" if counted else "a long, b long", partition)


def fitting(percent: int):
    """Sizes n and m that a link allows."""
    return (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)


def jaccard_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    A set: distinct runs of ``shingle`` words of the lower-cased text (A-Z only); the whole sequence for fewer words; nothing, and no link, without words.

    1. Documents of equal sets are one class, stood for by its first document.
    2. Similar classes are put into groups: signature bands propose a leader, classes of one leader are a group, and exact verification links with it.
    3. Token-group matrix: each class gives its rarest tokens, a prefix that must share so many with any set it links with.  By token, the matrix has
       the groups whose union holds it; a query's count over a group bounds its overlap with any member.  Only groups that reach the bound are opened.
    4. A group's members are compared with each other, and with those that opened the group, block by block in memory, each two once: what
       comes out is a spanning forest of the links and each class's number of links, not the pairs; a document whose overlap with a block's token union
       is too small is left out of it.
    5. Links of both steps make the components.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable), n_links (the different sets that its own links with; copies aside).
    Every link is found and counted.  A group's comparisons grow with the square of its classes, in cells of two blocks.  Null texts are empty.  Rows of equal id and text are one document, each returned;
    null ids get a component_id of the smallest id beside them, null if there is none.  Further columns are ignored; an empty table gives no rows.
    """
    docs = with_refs(df, text, doc_id)
    meta, classes, links, degree = find_links(docs, shingle, percent, counted=True)
    roots = components(links)
    table = classes.join(roots, F.col("rep") == F.col("node"), "left").select("class", "rep", F.coalesce("root", "rep").alias("root")).join(degree, "rep", "left")
    result = docs.select("doc_id", "ref").join(meta, "ref").join(table, "class", "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "ref").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if _renumbered(docs):
        names = result.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return result.join(names, "root").select("doc_id", "n_shingles", "component_id", "n_links")
    return result.select("doc_id", "n_shingles", F.col("root").alias("component_id"), "n_links")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """df with one document of each component: its first, by id.  Documents without words stay; of rows equal in id and text one stays."""
    docs = with_refs(df, text, doc_id, tuple(df.columns))
    meta, classes, links, _ = find_links(docs, shingle, percent)
    roots = components(links)
    first = classes.join(roots.where("node <> root"), F.col("rep") == F.col("node"), "left_anti").select(F.col("rep").alias("ref"))
    stay = stage_boundary(first.unionByName(meta.where("n = 0").select("ref")).distinct())
    kept = join_text(docs, stay)
    if _renumbered(docs):
        kept = kept.dropDuplicates(["ref"])
    return kept.select(*(F.col(f"keep{k}").alias(c) for k, c in enumerate(df.columns)))


def _renumbered(docs: DataFrame) -> bool:
    """Whether refs aren't the ids themselves."""
    return bool(docs.where(~F.col("ref").eqNullSafe(F.col("doc_id"))).limit(1).count())
