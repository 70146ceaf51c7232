"""The seam where a model runs: padded token batches of one bucket in, one vector per layer and record out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.tensors import bfloat16_bits, packed_array, rms_norm_rows
from ..sources.artifact import METADATA, vector_types

#: (tokens, mask), both of shape (batch, positions), to pairs of a layer's number and its states, of shape (batch, positions, width).
#: A layer may be given as soon as it is made: only its last position is kept.
Producer = Callable[[np.ndarray, np.ndarray], Iterable[tuple[int, np.ndarray]]]
#: The number under which a producer gives the states before its first layer.
EMBEDDING = -1
#: Columns by which a batch is known.
BATCH = ("rank", "bucket", "batch_id")


def stub_layers(width: int, layers: int = 0) -> Producer:
    """A deterministic stand-in for a model, in exact fractions: it says nothing about any model.

    A token's embedding at place j is ((31 token + 17 j) mod 97 - 48) / 64; layer k adds up the embeddings of a position and the k before it.
    """

    def produce(tokens: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        own = ((tokens[:, :, None].astype(np.int64) * 31 + np.arange(width) * 17) % 97 - 48).astype(np.float32) / 64 * mask[:, :, None]
        yield EMBEDDING, own
        total = np.zeros_like(own)
        for k in range(layers):
            total[:, k:] += own[:, : own.shape[1] - k]
            yield k, total

    return produce


def capture(tokens: np.ndarray, mask: np.ndarray, produce: Producer, width: int, layers: int, norm: np.ndarray | None = None, bfloat16: bool = False) -> np.ndarray:
    """(batch, 1 + layers, width): each record's last position before the first layer and behind each.

    Padding is on the left, so the last position is the last token.  Raises unless the producer gives each layer once, in this shape and in finite
    values; with a norm's weights the last layer is normed.
    """
    kept: dict[int, np.ndarray] = {}
    for number, states in produce(tokens, mask):
        if states.shape != (*tokens.shape, width):
            raise ValueError(f"layer {number} has the shape {states.shape}, not {(*tokens.shape, width)}")
        if number in kept:
            raise ValueError(f"layer {number} was given twice")
        kept[number] = np.array(states[:, -1, :], np.float32)
    if set(kept) != set(range(EMBEDDING, layers)):
        raise ValueError(f"layers {sorted(kept)} were given, not {EMBEDDING} to {layers - 1}")
    if norm is not None and layers:
        kept[layers - 1] = rms_norm_rows(kept[layers - 1], weight=norm, bfloat16=bfloat16)
    bad = [k for k in sorted(kept) if not np.isfinite(kept[k]).all()]
    if bad:
        raise ValueError(f"values that aren't finite in layers {', '.join(map(str, bad))}")
    return np.stack([kept[k] for k in range(EMBEDDING, layers)], axis=1)


def pad_batch(ids: Sequence[np.ndarray], length: int, rows: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, mask) of shape (rows, length): each record's last ``length`` tokens behind padding; the last record fills rows that are left."""
    tokens, mask = np.full((rows, length), pad, np.int64), np.zeros((rows, length), np.int8)
    for i in range(rows):
        own = ids[min(i, len(ids) - 1)][-length:]
        if len(own):
            tokens[i, length - len(own) :] = own
            mask[i, length - len(own) :] = 1
    return tokens, mask


def vector_arrays(stacked: np.ndarray, layers: int, dtype: str) -> list[pa.Array]:
    """Columns embedding and, with layers, hidden_states; their buffers are the array's, no Python lists are made."""
    rows, _, width = stacked.shape

    def lists(flat: np.ndarray, each: int) -> pa.Array:
        n = flat.size // width
        if dtype == "bfloat16":
            inner = packed_array(bfloat16_bits(flat).reshape(n, width))
        else:
            inner = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(flat, np.float32).ravel()))
        return inner if each == 0 else pa.ListArray.from_arrays(np.arange(0, n + 1, each, dtype=np.int32), inner)

    out = [lists(stacked[:, 0, :], 0)]
    return [*out, lists(stacked[:, 1:, :], layers)] if layers else out


def infer(plan: DataFrame, produce: Producer, width: int, layers: int = 0, batch: int = 1, pad: int = 0, dtype: str = "float32", norm: Sequence[float] | None = None) -> DataFrame:
    """The artifact's rows of a plan whose tasks hold whole shards in order, with token_ids, bucket and batch_id.

    A task cuts its rows into the plan's batches, each of one bucket, pads them and gives them to the producer; it holds one batch.
    """
    names = [x.split()[0] for x in METADATA.split(", ")]
    kinds = vector_types(layers or None, dtype)
    schema = StructType.fromDDL(METADATA + "".join(f", {n} {k}" for n, k in kinds.items()))
    weights = None if norm is None else np.asarray(norm, np.float32)
    columns = [*names, "batch_id", "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            lists = rows.column(len(columns) - 1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            ids = [flat[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            tokens, mask = pad_batch(ids, rows.column(names.index("bucket"))[0].as_py(), max(batch, len(ids)), pad)
            stacked = capture(tokens, mask, produce, width, layers, weights, dtype == "bfloat16")[: len(ids)]
            return pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *vector_arrays(stacked, layers, dtype)], names=[*names, *kinds])

        now = None
        for b in batches:
            keys = [b.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in BATCH]
            fresh = np.zeros(b.num_rows, bool)
            for k in keys:
                fresh[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(fresh).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                key = tuple(k[a] for k in keys)
                if held and key != now:
                    yield closed()
                now = key
                held.append(b.slice(a, z - a))
        if held:
            yield closed()

    return plan.select(*columns).mapInArrow(run, schema)
