"""Asking hash-partitioned tables about 64-bit keys of documents, many keys in a row.

Documents are dealt into buckets of about one size by a hash of id and text. A bucket asks each part
of the key space about its distinct keys, once however often they occur in the bucket, so a key that
a third of all rows share reaches its part once per bucket. A part adds up what the buckets hold and
replies to each. Both sides are plain group-bys; adaptive execution and the session's partition
count lay them out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import batches, words

#: Bytes of text in a bucket, about; a longer text makes its bucket larger.
BUCKET_BYTES = 8 << 20
#: Equal rows of a task that share a bucket.
TOGETHER = 16
#: Bytes of text that a task deals out at a time.
BUNDLED_BYTES = 32 << 20

REQUEST = "part int, bucket int, kind int, keys binary, counts binary"
REPLY = "bucket int, part int, kind int, totals binary"


def bucketed(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int, str]:
    """Bundles of rows by ``bucket``, the number of buckets, which follows the input, and the type of the ids.

    A task bundles its rows of a bucket, their texts compressed as one; ``rows_of`` unpacks them. Of
    rows that repeat each other in id and text, a few share a bucket and the rest go to others, so
    that many of them don't make one bucket large.
    """
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(size / bucket_bytes))
    order = F.xxhash64(F.col(id_col), text)
    rows = docs.select(F.col(id_col).alias("_id"), order.alias("_order"), text.alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def bundle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "_text", BUNDLED_BYTES):
            bucket = dealt(part.column("_order").to_numpy(), n)
            by_bucket = np.argsort(bucket, kind="stable")
            part, bucket = part.take(pa.array(by_bucket)), bucket[by_bucket]
            data, at = words.bytes_of(part.column("_text"))
            cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            offsets = pa.array(cut.astype(np.int32))
            packed = [pa.compress(data[at[a] : at[b]].tobytes(), codec="zstd", asbytes=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cut[:-1]]),
                    pa.ListArray.from_arrays(offsets, part.column("_id")),
                    pa.ListArray.from_arrays(offsets, part.column("_order")),
                    pa.ListArray.from_arrays(offsets, pa.array(np.diff(at))),
                    pa.array(packed, pa.binary()),
                ],
                ["bucket", "_id", "_order", "_size", "_text"],
            )

    return rows.mapInArrow(bundle, f"bucket int, _id array<{kind}>, _order array<long>, _size array<long>, _text binary"), n, kind


def dealt(order: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each row by its hash; ``TOGETHER`` rows of one hash share one, the next ones another."""
    at = np.argsort(order, kind="stable")
    first = np.r_[True, order[at][1:] != order[at][:-1]][: len(order)]
    turn = np.empty(len(order), np.int64)
    turn[at] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    spread = order.view(np.uint64) + (turn // TOGETHER).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (words.mix(spread) % np.uint64(buckets)).astype(np.int32)


def rows_of(bundles: pa.Table) -> pa.Table:
    """``_id`` and ``_text`` (null texts empty) of a bucket's rows, in an order that doesn't depend on how they were read."""
    flat = lambda c: pa.concat_arrays([x.flatten() for x in bundles.column(c).chunks])
    size = flat("_size").to_numpy()
    held = [int(x.sum()) for x in np.split(size, np.cumsum([len(x) for x in column(bundles, "_size")])[:-1])]
    raw = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) if n else b"" for x, n in zip(column(bundles, "_text").to_pylist(), held, strict=True))
    text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(raw)])
    order = pa.array(np.argsort(flat("_order").to_numpy(), kind="stable"))
    return pa.table([flat("_id").take(order), text.take(order)], names=["_id", "_text"])


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a group as one array."""
    chunks = table.column(name).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def slices(sorted_keys: np.ndarray, parts: int) -> tuple[list[int], list[int], list[int]]:
    """The parts that ascending keys fall into, and where the keys of each begin and end.

    The key space is cut into equal ranges by the upper half of the key.
    """
    if not len(sorted_keys):
        return [], [], []
    part = ((sorted_keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_keys)]


def request(bucket: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of ``REQUEST`` for ascending distinct keys and how often the bucket has each."""
    for p, a, b in zip(*slices(keys, parts), strict=True):
        yield p, bucket, kind, pack(keys[a:b]), numbers(counts[a:b])


def pack(keys: np.ndarray) -> bytes:
    """Ascending distinct keys: the first, then the steps between them in as many bytes as the widest needs."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return bytes([width]) + keys[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    step = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    out = np.zeros((len(step) + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    out[1:, : raw[0]] = step
    return np.cumsum(out.view(np.uint64).ravel())


def rows_table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


_REQUEST_FIELDS = [("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
_REPLY_FIELDS = [("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("totals", pa.binary())]


def requests_table(rows: list[tuple]) -> pa.Table:
    return rows_table(rows, _REQUEST_FIELDS)


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of requests to one part, and their totals."""
    keys = [unpack(x) for x in column(table, "keys").to_pylist()]
    counts = [from_numbers(x, len(k)) for x, k in zip(column(table, "counts").to_pylist(), keys, strict=True)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, place, np.concatenate(counts))
    return distinct, totals


def answer(requests: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """For each request its keys' totals over all buckets, in the order of the keys.

    The keys of one part and kind meet in one task: as many as a bucket has, about, since there are
    as many parts as buckets.
    """

    def add(table: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in column(table, "keys").to_pylist()]
        counts = [from_numbers(x, len(k)) for x, k in zip(column(table, "counts").to_pylist(), keys, strict=True)]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)[place]
        ends = np.cumsum([len(k) for k in keys])
        replies = [encode(totals[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
        return pa.table(
            [column(table, "bucket"), column(table, "part"), column(table, "kind"), pa.array(replies, pa.binary())],
            names=[n for n, _ in _REPLY_FIELDS],
        )

    return requests.groupBy("part", "kind").applyInArrow(add, REPLY)


def totals_of(replies: pa.Table, kind: int, dtype: type, decode: Callable[[bytes, int], np.ndarray], keys: np.ndarray, parts: int) -> np.ndarray:
    """The totals of one bucket's ascending keys of a kind, as its parts have replied."""
    got = {}
    if replies.num_rows:  # an empty side of a cogroup may come without columns
        rows = zip(*(column(replies, c).to_pylist() for c in ("kind", "part", "totals")), strict=True)
        got = {p: t for k, p, t in rows if k == kind}
    asked = list(zip(*slices(keys, parts), strict=True))
    if len(got) != len(asked):
        raise RuntimeError(f"{len(asked)} parts were asked and {len(got)} replied")
    return np.concatenate([decode(got[p], b - a) for p, a, b in asked]) if asked else np.zeros(0, dtype)


def bits(totals: np.ndarray) -> bytes:
    """One bit a key: whether it occurs more than once."""
    return np.packbits(totals > 1).tobytes()


def from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def numbers(totals: np.ndarray) -> bytes:
    """Totals as one byte each; those of 255 or more stand behind as 64-bit numbers."""
    large = totals >= 255
    return np.where(large, 255, totals).astype(np.uint8).tobytes() + totals[large].astype(np.int64).tobytes()


def from_numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.uint8, len(raw) - n, n).view(np.int64) if len(raw) > n else out[:0]
    return out
