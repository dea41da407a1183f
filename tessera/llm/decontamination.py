"""Finding benchmark items in documents by pigeonhole edit matching.

An item of n words may occur with k edited words, k a share of n. Split into k + 1 pieces, at least
one piece of any such occurrence is unchanged. Pieces are looked up among the runs of words of every
document by their numbers; around each hit, Myers' bit-parallel algorithm, with words as symbols,
gives the smallest edit distance of the item to any stretch of words there.

Items are taken in blocks of bounded size, each sent to the tasks and held against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, words
from tessera.sources.tables import table

#: Edited words that an occurrence may have, as a share of the item's words.
ERRORS = 0.2
#: Bytes of the items' text that are sent to the tasks at once, about.
BLOCK_BYTES = 4 << 20


def folded(column: pa.Array) -> words.Words:
    """Words in lower case without punctuation; characters beyond ASCII count if they are letters, marks or digits."""
    text = pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), r"[^\x00-\x7F\pL\pN\pM]+", " ")
    return words.split(text, gaps=words.NO_LETTERS)


def budget(n: int, errors: float = ERRORS) -> int:
    """Edits that an item of ``n`` words may have."""
    return min(n - 1, math.floor(errors * n + 1e-9))


def cut(n: int, parts: int) -> list[tuple[int, int]]:
    """``n`` words in ``parts`` runs of nearly one length: (first, length)."""
    at = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Items:
    """A block of items: their words' numbers, and for each length of pieces the sorted pieces."""

    ids: list
    number: list[np.ndarray]
    errors: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: (piece, item, offset)


def index(ids: list, texts: list[str], errors: float = ERRORS) -> Items:
    w = folded(pa.array(texts, pa.string()))
    number = words.numbers(w)
    own = [number[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    allowed = [budget(len(x), errors) if len(x) else 0 for x in own]
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, (x, k) in enumerate(zip(own, allowed, strict=True)):
        for at, n in cut(len(x), k + 1) if len(x) else ():
            by_length.setdefault(n, []).append((i, at))
    pieces = {}
    for n, where in by_length.items():
        gram, at = words.grams(number, w, n)
        item, offset = np.array(where).T
        key = gram[np.searchsorted(at, w.first[:-1][item] + offset)]
        order = np.argsort(key, kind="stable")
        pieces[n] = key[order], item[order], offset[order]
    return Items(ids, own, allowed, pieces)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The smallest edit distance of ``pattern`` to any stretch of ``text``, and the last symbol of the first such stretch (-1: an empty one)."""
    m = len(pattern)
    places: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, -1
    for j, x in enumerate(text.tolist()):
        eq = places.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best:
            best, end = score, j
    return best, end


def matches(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, distance, last word of the match) for the items that each text has."""
    w = folded(column)
    number, owner = words.numbers(w), w.owner()
    found = []
    for n, (key, item, offset) in items.pieces.items():
        gram, at = words.grams(number, w, n)
        low, high = np.searchsorted(key, gram, "left"), np.searchsorted(key, gram, "right")
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        which = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(at[hit], times)
        found.append(np.stack([owner[where], item[which], where - offset[which]]))
    if not found:
        return
    text, item, start = np.concatenate(found, axis=1)
    order = np.lexsort((start, item, text))
    text, item, start = text[order], item[order], start[order]
    i = 0
    while i < len(text):
        t, x = int(text[i]), int(item[i])
        m, k = len(items.number[x]), items.errors[x]
        first, last = int(w.first[t]), int(w.first[t + 1])
        best, end = k + 1, -1
        while i < len(text) and text[i] == t and item[i] == x:
            a, b = int(start[i]) - k, int(start[i]) + m + k
            i += 1
            while i < len(text) and text[i] == t and item[i] == x and start[i] - k <= b:
                b = int(start[i]) + m + k
                i += 1
            a = max(a, first)
            distance, at = myers(items.number[x], number[a : min(b, last)])
            if distance < best:
                best, end = distance, a + at - first
        if best <= k:
            yield t, x, best, end


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    errors: float = ERRORS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id_col``, ``item_col``, ``distance``, ``item_words``, ``last_word``: a row for each document and item in it.

    An item occurs if a stretch of the document's words is at most ``errors`` times its words away in
    edits of words, case and punctuation apart; ``distance`` is the smallest number of edits and
    ``last_word`` where the first such stretch ends. Items without words occur nowhere, and a null
    text is empty; an item of one word occurs in every document that has the word, so leave out of
    ``benchmark`` what is too short to mean anything. Repeated documents and items give repeated rows. If either table is empty, so is the
    result. Other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).cast("string").alias("_words")).where("_words is not null")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind, item_kind = rows.schema["_id"].dataType.simpleString(), items.schema["_item"].dataType.simpleString()
    schema = f"_id {kind}, _item {item_kind}, distance int, item_words int, last_word int"
    out = spark.createDataFrame([], schema)
    for known, times in _blocks(items, errors, block_bytes):

        def find(parts: Iterator[pa.RecordBatch], known: Items = known, times: list[int] = times) -> Iterator[pa.RecordBatch]:
            for part in batches.pieces(parts, "_text"):
                got = [m for m in matches(part.column("_text"), known) for _ in range(times[m[1]])]
                t, x, d, e = map(list, zip(*got, strict=True)) if got else ([], [], [], [])
                ids = part.column("_id").take(pa.array(t, pa.int64()))
                item = pa.array([known.ids[i] for i in x], item_type)
                n = pa.array([len(known.number[i]) for i in x], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, item, pa.array(d, pa.int32()), n, pa.array(e, pa.int32())], ["_id", "_item", "distance", "item_words", "last_word"]
                )

        item_type = _arrow(items)
        out = out.unionByName(rows.mapInArrow(find, schema))
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def _blocks(items: DataFrame, errors: float, block_bytes: int) -> Iterator[tuple[Items, list[int]]]:
    """Blocks of distinct items (``_item``, ``_words``) with about ``block_bytes`` of text, and how often each is listed.

    A block is what comes to the driver and goes to the tasks at a time.
    """
    distinct = items.groupBy("_item", "_words").agg(F.count("*").alias("_times"))
    size = distinct.agg(F.sum(F.octet_length("_words"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("_item", "_words"), F.lit(blocks)) == b).collect()
        if block:
            yield index([r[0] for r in block], [r[1] for r in block], errors), [r[2] for r in block]


def _arrow(items: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(items.schema["_item"].dataType)


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    errors: float = ERRORS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in whose texts no item occurs, all columns.

    Every row is judged by its own text where it is read, without a shuffle; blocks of items are
    filters one behind the other over a single scan. A null text is empty and stays. Repeated rows
    stay or go together.
    """
    items = benchmark.select(F.lit(0).alias("_item"), F.col(item_text_col).cast("string").alias("_words")).where("_words is not null")
    for known, _ in _blocks(items, errors, block_bytes):

        def clean(parts: Iterator[pa.RecordBatch], known: Items = known) -> Iterator[pa.RecordBatch]:
            for part in batches.pieces(parts, text_col):
                bad = {m[0] for m in matches(pc.cast(part.column(text_col), pa.string()), known)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
