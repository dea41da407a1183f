"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens; the distinct ones of a piece of text are merged together as ragged
numpy arrays (see :meth:`tessera.llm.bpe.ByteBpe.merge`) and their surviving symbols counted. A
worker remembers short pre-tokens (see :class:`tessera.llm.bpe.Memory`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, bpe
from tessera.sources.tables import table

TOKEN_LIMIT = 1024


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``: one row per row of ``docs``.

    Counts are those of the tokenizers library without added special tokens; special strings inside
    a text count as one token each. A null text counts as empty (0 and 0); null ids and repeated
    rows stay as they are. Other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = bpe.Memory(bpe.load(tokenizer))
        for part in batches.pieces(parts, "_text"):
            text = part.column("_text")
            sizes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), sizes, pa.array(memory.counts(text))], ["_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {"op3_token_counts": op3_token_counts}
