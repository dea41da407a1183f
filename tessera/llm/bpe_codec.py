"""BPE encoding and decoding by tree concatenation.

A pre-token that nothing splits may be very long. Such a run is cut into halves, and those again,
down to leaves that are all encoded together as one ragged batch. Two neighbours are then joined by
encoding a window of tokens around the join anew. The window grows until its first token is the one
that the left side had there and its last the one that the right side had; every pair of adjacent
tokens is then as the merges would leave it, so the joined tokens are those of the whole. All joins
of one level of the tree are tried at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, bpe
from tessera.sources.tables import table

#: Runs of more bytes are cut into halves.
LEAF_BYTES = 256
#: Tokens on either side of a join in the first window.
WINDOW = 4


def _encode_plain(sequences: list[bytes], vocabulary: bpe.ByteBpe) -> list[list[int]]:
    ids, offsets = vocabulary.merge(sequences)
    flat = ids.tolist()
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _leaves(run: bytes, leaf: int) -> list[bytes]:
    """``run`` in 2**k parts of nearly one size, of ``leaf`` bytes at most."""
    parts = 1
    while len(run) > leaf * parts:
        parts *= 2
    cuts = [len(run) * i // parts for i in range(parts + 1)]
    return [run[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _joined(pairs: list[tuple[list[int], list[int]]], vocabulary: bpe.ByteBpe, window: int) -> list[list[int]]:
    """The tokens of each left and right side taken together."""
    out: list[list[int] | None] = [None] * len(pairs)
    width = [window] * len(pairs)
    open_ = list(range(len(pairs)))
    token_bytes = vocabulary.token_bytes
    while open_:
        spans = [(pairs[i][0][-width[i] :], pairs[i][1][: width[i]]) for i in open_]
        encoded = _encode_plain([b"".join(map(token_bytes.__getitem__, a + b)) for a, b in spans], vocabulary)
        again = []
        for i, (a, b), new in zip(open_, spans, encoded, strict=True):
            left, right = pairs[i]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if len(new) > 1 and (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]) or whole_left and whole_right:
                out[i] = left[: len(left) - len(a)] + new + right[len(b) :]
            else:
                width[i] *= 2
                again.append(i)
        open_ = again
    return out


def encode_runs(runs: list[bytes], vocabulary: bpe.ByteBpe, leaf: int = LEAF_BYTES, window: int = WINDOW) -> list[list[int]]:
    """The token ids of each run of bytes."""
    trees = [_leaves(r, leaf) for r in runs]
    flat = _encode_plain(list(chain.from_iterable(trees)), vocabulary)
    at, levels = 0, []
    for t in trees:
        levels.append(flat[at : at + len(t)])
        at += len(t)
    while any(len(x) > 1 for x in levels):
        open_ = [k for k, x in enumerate(levels) if len(x) > 1]
        joined = iter(_joined([(x[i], x[i + 1]) for x in (levels[k] for k in open_) for i in range(0, len(x), 2)], vocabulary, window))
        for k in open_:
            levels[k] = [next(joined) for _ in range(len(levels[k]) // 2)]
    return [x[0] for x in levels]


def encoder(vocabulary: bpe.ByteBpe) -> bpe.Encode:
    """Sequences of ``LEAF_BYTES`` at most are merged together, longer ones as trees."""

    def encode(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        long_ = [i for i, x in enumerate(sequences) if len(x) > LEAF_BYTES]
        ids, offsets = vocabulary.merge([b"" if len(x) > LEAF_BYTES else x for x in sequences])
        return bpe.splice(ids, offsets, long_, encode_runs([sequences[i] for i in long_], vocabulary)) if long_ else (ids, offsets)

    return encode


def bpe_codec(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    decoded: bool = True,
) -> DataFrame:
    """``id_col``, ``ids`` (array of int) and, if asked for, ``decoded`` (the text of those ids).

    One row per row of ``docs``; a null text counts as empty (no ids, empty text). Special strings
    inside a text become their own ids. Other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(tokenizer)
        memory = bpe.Memory(vocabulary, encoder(vocabulary))
        for part in batches.pieces(parts, "_text"):
            ids, offsets = memory.ids(part.column("_text"))
            cols = [part.column("_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
            if decoded:
                cols.append(vocabulary.decode(ids, offsets).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["_id", "ids", "decoded"][: len(cols)])

    schema = f"_id {kind}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(encode, schema).withColumnRenamed("_id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``id_col`` and ``text``, the text of the token ids in ``ids_col`` (null: empty)."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(tokenizer)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                sizes = pc.fill_null(pc.list_value_length(some.column("_ids")), 0).to_numpy(zero_copy_only=False)
                ids = some.column("_ids").flatten().to_numpy(zero_copy_only=False)
                texts = vocabulary.decode(ids, np.r_[0, np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([some.column("_id"), texts.cast(pa.string())], ["_id", "text"])

    return rows.mapInArrow(decode, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_codec(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe_codec": op4_bpe_codec}
