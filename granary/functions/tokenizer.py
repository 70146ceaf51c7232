"""The tokenizer seam: word numbers, or byte-pair merges by rank from a vocabulary file."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .text import tokens

#: Pieces that merges don't cross: letters, digits, other marks, each with a space before it, and white space.
PIECES = r"\s?[^\W\d_]+|\s?\d+|\s?(?:[^\w\s]|_)+|\s+"
#: Bytes of a vocabulary that is broadcast; a larger one is refused.
VOCABULARY_BYTES = 64 << 20
#: Distinct pieces whose ids a task remembers, and their length.
REMEMBERED, REMEMBERED_LENGTH = 1 << 17, 64
#: Numbers of the plain word tokenizer.
WORD_IDS = 50_000


def word_ids(text: Column) -> Column:
    """A number below WORD_IDS for each word of a text: a stand-in that needs no vocabulary."""
    return F.transform(tokens(text), lambda w: F.pmod(F.crc32(w), F.lit(WORD_IDS)).cast("int"))


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: its bytes, of which the adjacent pair of least rank is joined, of equal ones the first, until no pair has a rank.

    Pairs wait in a heap and joined ones are skipped, so a piece of n bytes takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    end, last = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))  # a token's end, and the start of the token before it
    heap = []

    def push(a: int) -> None:
        b = end[a]
        if a >= 0 and b < len(piece):
            rank = ranks.get(piece[a : end[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

    for i in range(len(piece) - 1):
        push(i)
    alive = [True] * len(piece)
    while heap:
        _, a, b, z = heapq.heappop(heap)
        if not (alive[a] and end[a] == b and b < len(piece) and alive[b] and end[b] == z):
            continue
        alive[b], end[a] = False, z
        if z < len(piece):
            last[z] = a
        push(a)
        if last[a] >= 0:
            push(last[a])
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file's tokens and ranks: a line holds a token in base 64 and its rank.  Raises beyond VOCABULARY_BYTES or without all single bytes."""
    lines = spark.read.text(path).where("value <> ''")
    size = lines.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    if size > VOCABULARY_BYTES:
        raise ValueError(f"{path}: {size} bytes of vocabulary, more than {VOCABULARY_BYTES}")
    ranks = {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in lines.collect())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path}: {len(missing)} single bytes have no rank")
    return ranks


def merge_ids(spark: SparkSession, ranks: dict[bytes, int], pattern: str = PIECES) -> Callable[[Column], Column]:
    """A column function from texts to token ids, with the ranks broadcast once; what the pattern doesn't match makes no token, null texts have none."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        own, known, cut = shared.value, {}, re.compile(pattern)
        flat, ends = array("i"), array("q", [0])  # ids in four bytes each, and one text at a time as a string
        for k in range(len(texts)):
            for m in cut.finditer(texts[k].as_py() or ""):
                piece = m.group()
                found = known.get(piece)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = merge_piece(piece.encode(), own)
                    if len(piece) <= REMEMBERED_LENGTH:
                        known[piece] = found
                flat.extend(found)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(np.frombuffer(ends, np.int64).astype(np.int32), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))

    return ids
