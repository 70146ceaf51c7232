"""Vector columns: norms, checks, layers.  Values are float, in which bfloat16 values are exact."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType


def rms_norm(v: Column, eps: float = 1e-5, weight: Column | None = None) -> Column:
    """x / sqrt(mean(x^2) + eps), times weight if there is one; folded in doubles."""
    square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    scale = 1 / F.sqrt(square / F.size(v) + eps)
    out = F.transform(v, lambda x: x.cast("double") * scale)
    return out if weight is None else F.zip_with(out, weight, lambda a, b: a * b)


def is_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())


def offending_layers(states: Column) -> Column:
    """Numbers of the layers that hold a value that isn't finite."""
    marks = F.transform(states, lambda v, i: F.when(is_finite(v), F.lit(None)).otherwise(i))
    return F.filter(marks, lambda i: i.isNotNull())


def require_finite(states: Column) -> Column:
    bad = offending_layers(states)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("values that aren't finite in layers "), F.array_join(bad.cast("array<string>"), ",")))).otherwise(states)


def has_shape(v: Column, shape: Sequence[int]) -> Column:
    """Whether a vector, or a list of vectors, has exactly this shape."""
    if len(shape) == 1:
        return F.coalesce(F.size(v) == shape[0], F.lit(False))
    return F.coalesce((F.size(v) == shape[0]) & ~F.exists(v, lambda x: F.coalesce(F.size(x) != shape[1], F.lit(True))), F.lit(False))


def last_position(sequence: Column) -> Column:
    return F.element_at(sequence, -1)


def split_layers(stacked: Column) -> tuple[Column, Column]:
    """(embedding, hidden states) of one record's stacked vectors."""
    return F.element_at(stacked, 1), F.slice(stacked, 2, F.greatest(F.size(stacked) - 1, F.lit(0)))


def stack_layers(embedding: Column, states: Column) -> Column:
    return F.concat(F.array(embedding), states)


def complete_layers(by_layer: Column, layers: int) -> Column:
    """Whether a map from layer number to vector has exactly the layers 0 to layers - 1."""
    return F.array_sort(F.map_keys(by_layer)) == F.sequence(F.lit(0), F.lit(layers - 1))


def bfloat16_bits(x: np.ndarray) -> np.ndarray:
    """The two bytes of each float as a bfloat16: the upper half, rounded to the nearest, ties to even; a NaN stays one."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    rounded = ((bits + (np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1)))) >> np.uint32(16)).astype(np.uint16)
    nan = (bits & np.uint32(0x7FFFFFFF)) > np.uint32(0x7F800000)
    return np.where(nan, (bits >> np.uint32(16)).astype(np.uint16) | np.uint16(0x40), rounded)


def bfloat16_floats(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << np.uint32(16)).view(np.float32)


def bfloat16_finite(bits: np.ndarray) -> np.ndarray:
    """Whether each value is finite: not all bits of its exponent are set."""
    return (bits & np.uint16(0x7F80)) != np.uint16(0x7F80)


def _binary_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and its offsets."""
    column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def packed_array(bits: np.ndarray) -> pa.Array:
    """A (rows, width) array of bfloat16 bits as a binary column, two bytes a value, the lower first."""
    rows, width = bits.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(2 * width)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bits, "<u2").tobytes())])


@F.arrow_udf(BinaryType())
def pack_bfloat16(v: pa.Array) -> pa.Array:
    """A vector of floats as bytes of bfloat16, two a value: half of the size.  Null stays null; a null element becomes NaN."""
    flat = np.asarray(v.flatten().fill_null(float("nan")), np.float32)
    size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32) * np.int32(2)
    mask = pa.array(np.asarray(v.is_null())).cast(pa.bool_())
    out = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(bfloat16_bits(flat).astype("<u2").tobytes())])
    return pc.if_else(mask, pa.scalar(None, pa.binary()), out)


@F.arrow_udf(ArrayType(FloatType()))
def unpack_bfloat16(b: pa.Array) -> pa.Array:
    """The floats of packed bfloat16 bytes."""
    raw, offsets = _binary_values(b)
    floats = bfloat16_floats(np.frombuffer(raw.tobytes(), "<u2"))
    return pa.ListArray.from_arrays(pa.array((offsets // 2).astype(np.int32)), pa.array(floats), mask=b.is_null())


@F.arrow_udf(BooleanType())
def packed_finite(b: pa.Array) -> pa.Array:
    """Whether all values of packed bfloat16 bytes are finite, by their bits alone; null for null."""
    raw, offsets = _binary_values(b)
    bad = np.concatenate(([0], np.cumsum(~bfloat16_finite(np.frombuffer(raw.tobytes(), "<u2")))))
    fine = bad[offsets[1:] // 2] == bad[offsets[:-1] // 2]
    return pa.array(fine, mask=np.asarray(b.is_null()))


def rms_norm_rows(x: np.ndarray, eps: float = 1e-5, weight: np.ndarray | None = None, bfloat16: bool = False) -> np.ndarray:
    """RMSNorm along the last axis in float32; as bfloat16 the normed values are rounded before the weight multiplies them, and so is the product."""
    cast = (lambda v: bfloat16_floats(bfloat16_bits(v))) if bfloat16 else (lambda v: v.astype(np.float32))
    x = np.asarray(x, np.float32)
    out = cast(x * (1 / np.sqrt(np.mean(x * x, axis=-1, keepdims=True, dtype=np.float32) + np.float32(eps))).astype(np.float32))
    return out if weight is None else cast(cast(np.asarray(weight, np.float32)) * out)


def to_bfloat16(v: Column) -> Column:
    """Floats rounded to the nearest bfloat16, ties to even; NaN and infinities as they are."""
    return unpack_bfloat16(pack_bfloat16(v))
