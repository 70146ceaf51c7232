"""Connected components of a link table, distributed.

Links stay where they are; each node has an owner, the part of its label, which knows the label that the node has been joined to.
In a round a part joins its links to local components, asks each label's owner once, with the least label that it is linked to, and
replaces labels by the answers.  Owners hear of a label at most once from each part, so a hub's links never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage_boundary
from ._arrow import map_partition
from ._kernel import mix64, unmix64
from ._packed import blobs, deal, exchange, map_packed, parts_of, unpack

_U = np.uint64
#: Kinds of packed rows: links, owned labels, questions, answers, a part that isn't settled.
LINKS, OWNED, ASKS, ANSWERS, OPEN = range(5)
#: Rounds between two lineage cuts.
ROUNDS = 2
#: Links of a part that are worth a task; fewer parts than the session's do for fewer links.
PART_LINKS = 1 << 16
#: Links, whatever the corpus, up to which one task joins all of them at once: rounds of exchanges would cost more than the work.
FEW_LINKS = 1 << 13


def _owner(label: np.ndarray, parts: int) -> np.ndarray:
    return (label % _U(parts)).astype(np.int32)


def least_of_ties(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, least label of its component) of all labels in the links a - b, by one task's links alone."""
    label, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(label))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == root).all():
            return label, label[root]
        root = new


def _look_up(table: np.ndarray, value: np.ndarray, key: np.ndarray) -> np.ndarray:
    """value of each key in the sorted table; the key itself where it isn't there."""
    if not len(table):
        return key
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, value[at], key)


def _ask(parts: int, last: bool):
    def partition(batches) -> Iterator[tuple[int, int, bytes]]:
        found = blobs(batches)
        home = next((part for rows in found.values() for part, _ in rows), 0)
        a, b = unpack([x for _, x in found.get(LINKS, [])], ["<u8", "<u8"])
        own, to = unpack([x for _, x in found.get(OWNED, [])], ["<u8", "<u8"])
        asked, answer = unpack([x for _, x in found.get(ANSWERS, [])], ["<u8", "<u8"])
        order = np.argsort(asked)
        asked, answer = asked[order], answer[order]
        a, b = _look_up(asked, answer, a), _look_up(asked, answer, b)
        apart = a != b
        label, least = least_of_ties(a[apart], b[apart])
        further = _look_up(asked, answer, to)
        moved = bool((further != to).any())
        to = further
        tied = label != least
        yield from deal(LINKS, np.full(int(tied.sum()), home, np.int32), [label[tied], least[tied]])
        yield from deal(OWNED, _owner(own, parts), [own, to])
        if last:
            if tied.any() or moved:
                yield OPEN, home, b""
            return
        more = np.unique(to[to != own])
        asks, wish = np.concatenate((label, more)), np.concatenate((least, more))
        yield from deal(ASKS, _owner(asks, parts), [asks, wish, np.full(len(asks), home, np.int32)])

    return partition


def _answer(parts: int):
    def partition(batches) -> Iterator[tuple[int, int, bytes]]:
        found = blobs(batches)
        for kind in (LINKS,):
            for part, blob in found.get(kind, []):
                yield kind, part, blob
        own, to = unpack([x for _, x in found.get(OWNED, [])], ["<u8", "<u8"])
        asks, wish, home = unpack([x for _, x in found.get(ASKS, [])], ["<u8", "<u8", "<i4"])
        label = np.unique(np.concatenate((own, asks)))
        state = label.copy()
        state[np.searchsorted(label, own)] = to
        at = np.searchsorted(label, asks)
        best = label.copy()
        np.minimum.at(best, at, wish)
        state = np.where(state == label, best, state)  # only a label that isn't joined yet is
        yield from deal(OWNED, _owner(label, parts), [label, state])
        yield from deal(ANSWERS, home, [asks, state[at]])

    return partition


def _names(parts: int, step: int):
    """Three steps that give each label the least node of its component."""

    def ask(batches):
        found = blobs(batches)
        home = next((part for rows in found.values() for part, _ in rows), 0)
        own, to = unpack([x for _, x in found.get(OWNED, [])], ["<u8", "<u8"])
        node = unmix64(own).view(np.int64)
        root, at = np.unique(to, return_inverse=True)
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, at, np.minimum(node, unmix64(to).view(np.int64)))
        yield from deal(OWNED, _owner(own, parts), [own, to])
        yield from deal(ASKS, _owner(root, parts), [root, least, np.full(len(root), home, np.int32)])

    def answer(batches):
        found = blobs(batches)
        for part, blob in found.get(OWNED, []):
            yield OWNED, part, blob
        root, node, home = unpack([x for _, x in found.get(ASKS, [])], ["<u8", "<i8", "<i4"])
        label, at = np.unique(root, return_inverse=True)
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, at, node)
        yield from deal(ANSWERS, home, [root, least[at]])

    return (ask, answer)[step]


def _rows(batches):
    found = blobs(batches)
    own, to = unpack([x for _, x in found.get(OWNED, [])], ["<u8", "<u8"])
    root, least = unpack([x for _, x in found.get(ANSWERS, [])], ["<u8", "<i8"])
    order = np.argsort(root)
    root, least = root[order], least[order]
    name = least[np.searchsorted(root, to)] if len(root) else least
    for i in range(0, len(own), 1 << 17):
        yield {"node": unmix64(own[i : i + (1 << 17)]).view(np.int64), "root": name[i : i + (1 << 17)]}


def _at_once(batches):
    cols = [[b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for b in batches]
    if not cols:
        return
    a, b = (np.concatenate([c[i] for c in cols]) for i in (0, 1))
    node, root = least_of_ties(a[a != b], b[a != b])
    yield {"node": node, "root": root}


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node, root the component's smallest node.

    Labels are hashed nodes, so that chains of least neighbours are short whatever the nodes' order; rounds grow as a logarithm.
    A round is two exchanges of packed labels; ROUNDS of them are one job, cut by a checkpoint, and the last one's open parts tell whether
    another is needed.  Links of a node to itself and repeated ones don't matter; nodes without links have no row.  links is read twice, so give a
    table or a checkpoint: its count tells how many parts the rounds need, as many as the session's shuffle partitions at most, and whether it is at most
    FEW_LINKS, which need no rounds.
    """
    n = links.count()
    if n <= FEW_LINKS:
        return map_partition(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).coalesce(1), "node long, root long", _at_once)
    parts = min(parts_of(links), max(links.sparkSession.sparkContext.defaultParallelism, -(-n // PART_LINKS)))

    def to_packed(batches):
        for k, batch in enumerate(batches):
            x, y = (mix64(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)) for i in (0, 1))
            label, least = least_of_ties(x, y)
            tied = label != least
            own = label[tied]
            # A batch's links go to one part, another one each time.
            yield from deal(LINKS, np.full(len(own), (int(own[0]) + k) % parts if len(own) else 0, np.int32), [own, least[tied]])

    state = map_packed(links.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), to_packed)
    while True:
        for _ in range(ROUNDS):
            state = map_packed(exchange(state, parts), _ask(parts, False))
            state = map_packed(exchange(state, parts), _answer(parts))
        state = stage_boundary(map_packed(exchange(state, parts), _ask(parts, True)))
        if state.where(F.col("kind") == OPEN).isEmpty():
            break
    state = state.where(F.col("kind") == OWNED)
    for step in (0, 1):
        state = map_packed(exchange(state, parts), _names(parts, step))
    return map_partition(exchange(state, parts), "node long, root long", _rows)
