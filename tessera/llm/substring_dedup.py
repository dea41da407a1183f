"""Removing repeated passages by relative Lempel-Ziv parsing.

Documents are dealt into reference blocks. Every block indexes the places of its windows of W
consecutive words, in hash partitions, and every document is factored against all blocks. A factor
starts at a window that stands at another place as well, takes the first such place of all blocks as
its source and is extended greedily, word by word, as long as the next window's source is the next
place. At its end the parse goes on with the next window, which overlaps the factor: so windows over
a factor's boundary are looked up in their own right, and no repeated window that lies across two
factors is missed. Factors have W words at least and their words are removed.

To keep the index small, a window is only looked up if its anchor, the smallest number among the
shorter runs of words within it, occurs at two places or more: equal windows have equal anchors at
equal offsets, and only about one place in thirteen is an anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exchange, words
from tessera.sources.tables import table

WINDOW = 35
#: Words in the runs that anchors are taken from.
ANCHOR_WORDS = 12
_ANCHORS, _WINDOWS = 0, 1
_SPREAD = np.uint64(0xA24BAED4963EE407)
#: A window that stands nowhere else.
NOWHERE = np.uint64(2**64 - 1)


@dataclass
class Parsed:
    """A bucket's words, the window numbers with the word where each starts, and their anchors."""

    words: words.Words
    window: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    anchor_keys: np.ndarray
    anchor_counts: np.ndarray


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values, the place of its smallest, the leftmost of several."""
    place = np.arange(len(values))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        covered += step
    return place


def parse(column: pa.Array, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> Parsed:
    w = words.split(column)
    number = words.numbers(w)
    run, run_at = words.grams(number, w, anchor_words)
    number_window, at = words.grams(number, w, window)
    width = window - anchor_words + 1
    # Runs of a text stand together, so those of the window at word x are the ones from its own run on.
    first_run = np.searchsorted(run_at, at)
    place = _leftmost_minima(run, width)[first_run] if len(at) else np.zeros(0, np.int64)
    # Smallest numbers lie close to 0: mixed anew, they spread over all parts of the index.
    anchor = words.mix(run[place] + _SPREAD)
    keys, counts = np.unique(words.mix(run[np.unique(place)] + _SPREAD), return_counts=True)
    return Parsed(w, number_window, at, anchor, keys, counts)


def _candidates(parsed: Parsed, repeated_anchor: np.ndarray) -> np.ndarray:
    """Which windows have an anchor that occurs again."""
    if not len(parsed.at):
        return np.zeros(0, bool)
    return repeated_anchor[np.searchsorted(parsed.anchor_keys, parsed.anchor)]


def _anchor_bits(parsed: Parsed, replies: pa.Table, parts: int) -> np.ndarray:
    return exchange.totals_of(replies, _ANCHORS, bool, exchange.from_bits, parsed.anchor_keys, parts)


def _places(blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places as numbers that order by block, then word."""
    return (blocks.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)


def _asked(bucket: int, window: np.ndarray, at: np.ndarray, parts: int) -> list[tuple]:
    """Requests for the distinct windows of a block with the first place of each; ``at`` ascends."""
    keys, first = np.unique(window, return_index=True)
    return [(p, bucket, _WINDOWS, exchange.pack(keys[a:b]), at[first[a:b]].astype(np.uint32).tobytes()) for p, a, b in zip(*exchange.slices(keys, parts), strict=True)]


def _first_elsewhere(table: pa.Table) -> pa.Table:
    """For each request to a part its windows' first places in other blocks, in the order of the windows."""
    buckets = exchange.column(table, "bucket").to_numpy()
    keys = [exchange.unpack(x) for x in exchange.column(table, "keys").to_pylist()]
    size = np.array(list(map(len, keys)))
    key = np.concatenate(keys)
    place = _places(np.repeat(buckets, size), np.frombuffer(b"".join(exchange.column(table, "counts").to_pylist()), np.uint32))
    order = np.lexsort((place, key))
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    held = np.diff(np.r_[first, len(key)])  # a block asks about a window once
    least, next_ = place[order[first]], np.full(len(first), NOWHERE)
    next_[held > 1] = place[order[first[held > 1] + 1]]
    other = np.empty(len(key), np.uint64)
    other[order] = np.where(np.arange(len(key)) == np.repeat(first, held), np.repeat(next_, held), np.repeat(least, held))
    ends = np.cumsum(size)
    replies = [_sources(other[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    return pa.table([exchange.column(table, c) for c in ("bucket", "part", "kind")] + [pa.array(replies, pa.binary())], names=["bucket", "part", "kind", "totals"])


def _sources(other: np.ndarray) -> bytes:
    some = other != NOWHERE
    return np.packbits(some).tobytes() + other[some].tobytes()


def _from_sources(raw: bytes, n: int) -> np.ndarray:
    some = exchange.from_bits(raw[: -(-n // 8)], n)
    out = np.full(n, NOWHERE)
    out[some] = np.frombuffer(raw, np.uint64, int(some.sum()), -(-n // 8))
    return out


def sources(at: np.ndarray, block: int, elsewhere: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The first place of each window other than its own. ``elsewhere``: the first in other blocks, by
    distinct window; ``of``: which of them each is; ``at`` ascends."""
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])[: len(elsewhere)]
    held = np.diff(np.r_[first, len(of)])
    own = _places(np.full(len(at), block), at)
    least, next_ = own[order[first]], np.full(len(first), NOWHERE)
    next_[held > 1] = own[order[first[held > 1] + 1]]
    here = np.where(own == least[of], next_[of], least[of])
    return np.minimum(here, elsewhere[of])


def factors(source: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors from the windows' sources: text, first word, words, source."""
    found = source != NOWHERE
    hit, source = at[found], source[found]
    if not len(hit):
        z = np.zeros(0, np.int64)
        return z, z, z, source
    new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]) | (source[1:] != source[:-1] + np.uint64(1))]
    start = np.flatnonzero(new)
    last = np.r_[start[1:], len(hit)] - 1
    return owner[hit[start]], hit[start], hit[last] - hit[start] + window, source[start]


def _keep(w: words.Words, covered: np.ndarray) -> tuple[list[str], np.ndarray]:
    """For each text its words that aren't covered, joined by one space, and the number covered."""
    stay = np.flatnonzero(~covered)
    owner = w.owner()
    data = w.data.copy()
    kept = np.zeros(len(data), np.int8)
    if len(stay):
        first = np.r_[True, owner[stay[1:]] != owner[stay[:-1]]]
        edge = np.zeros(len(data) + 1, np.int32)
        edge[w.starts[stay]] += 1
        edge[w.ends[stay]] -= 1
        kept = np.cumsum(edge[:-1]).astype(bool)
        gap = w.starts[stay[~first]] - 1
        kept[gap] = True
        data[gap] = 32
    kept = kept.astype(bool)
    ends = np.r_[0, np.cumsum(kept)][w.text_at]
    flat = data[kept].tobytes()
    texts = [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return texts, np.bincount(owner[covered], minlength=len(texts))


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor_words: int = ANCHOR_WORDS,
    bucket_bytes: int = exchange.BUCKET_BYTES,
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``text`` (the words that stay, joined by one space) and
    ``factors`` (array of first word, number of words, and the reference block and word there that
    the source begins at): one row per row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in the same
    document or another. Equal rows repeat each other and so lose such windows. A null or short text
    has no window; null ids are kept as they are; other columns are ignored whatever their names.
    Windows with equal numbers in one reference block are taken as equal.
    """
    if not 1 <= anchor_words <= window:
        raise ValueError("anchors need 1 to window words")
    rows, parts, kind = exchange.bucketed(docs, id_col, text_col, bucket_bytes)

    def ask_anchors(table: pa.Table) -> pa.Table:
        p = parse(exchange.column(exchange.rows_of(table), "_text"), window, anchor_words)
        bucket = table.column("bucket")[0].as_py()
        return exchange.requests_table(list(exchange.request(bucket, _ANCHORS, p.anchor_keys, p.anchor_counts, parts)))

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return exchange.requests_table([])
        p = parse(exchange.column(exchange.rows_of(table), "_text"), window, anchor_words)
        maybe = _candidates(p, _anchor_bits(p, replies, parts))
        return exchange.requests_table(_asked(table.column("bucket")[0].as_py(), p.window[maybe], p.at[maybe], parts))

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        bucket, table = table.column("bucket")[0].as_py(), exchange.rows_of(table)
        p = parse(exchange.column(table, "_text"), window, anchor_words)
        source = np.full(len(p.at), NOWHERE)
        if replies.num_rows:
            maybe = np.flatnonzero(_candidates(p, _anchor_bits(p, replies, parts)))
            keys, of = np.unique(p.window[maybe], return_inverse=True)
            elsewhere = exchange.totals_of(replies, _WINDOWS, np.uint64, _from_sources, keys, parts)
            source[maybe] = sources(p.at[maybe], bucket, elsewhere, of)
        text, first, n, source = factors(source, p.at, p.words.owner(), window)
        edge = np.zeros(len(p.words.starts) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + n, -1)
        texts, removed = _keep(p.words, np.cumsum(edge[:-1]) > 0)
        of = np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))].astype(np.int32)
        spans = pa.StructArray.from_arrays(
            [
                pa.array(p.words.place()[first], pa.int32()),
                pa.array(n, pa.int32()),
                pa.array((source >> np.uint64(32)).astype(np.int32)),
                pa.array((source & np.uint64(2**32 - 1)).astype(np.int64)),
            ],
            ["first", "n", "source_block", "source_word"],
        )
        return pa.table(
            [
                exchange.column(table, "_id"),
                pa.array(p.words.counts(), pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(texts, pa.string()),
                pa.ListArray.from_arrays(pa.array(of), spans),
            ],
            names=["_id", "n_words", "n_removed", "text", "factors"],
        )

    by_bucket = rows.groupBy("bucket")
    anchors = exchange.answer(by_bucket.applyInArrow(ask_anchors, exchange.REQUEST), exchange.bits)
    asked = by_bucket.cogroup(anchors.groupBy("bucket")).applyInArrow(ask_windows, exchange.REQUEST)
    both = anchors.unionByName(asked.groupBy("part").applyInArrow(_first_elsewhere, exchange.REPLY))
    span = "struct<first:int,n:int,source_block:int,source_word:long>"
    schema = f"_id {kind}, n_words long, n_removed long, text string, factors array<{span}>"
    return by_bucket.cogroup(both.groupBy("bucket")).applyInArrow(remove, schema).withColumnRenamed("_id", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


QUERIES = {"op8_substring_dedup": op8_substring_dedup}

ORACLE_SQL = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
j AS (SELECT w.doc_id, w.i, w.word, r.i AS window_at FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
m AS (SELECT doc_id, i, word,
             max(window_at) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS start FROM j),
k AS (SELECT doc_id, count(*) AS n_words, count(start) AS n_removed,
             coalesce(string_agg(CASE WHEN start IS NULL THEN word END, ' ' ORDER BY i), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
}
