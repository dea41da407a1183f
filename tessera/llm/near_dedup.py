"""Near-duplicate detection by an inverted join of MinHash signature coordinates.

1. A document's set of word shingles gives a signature of 64 coordinates. Documents with equal sets
   form a class; from here on a class stands for all its copies.
2. Every class is posted under each of its coordinate-value pairs, and postings are counted. With T
   the least number of coordinates that two classes must have in common, a class with fewer than T
   pairs that others have too is done.
3. Prefix: all pairs are ordered by the length of their posting. Two classes with T in common share
   one among the 64 - T + 1 rarest pairs of each, so only those postings are merged; the longest
   ones are skipped.
4. In a merged posting a class is held against a pivot after the other; equal coordinates of the
   whole signatures are counted, and a pair counts at the lowest prefix coordinate that it shares
   only. Once a class has a partner with T in common it needs no other.
5. The texts of classes with partners are read again and similarity is confirmed on the full shingle
   sets, each class against those that aren't in its component yet. Components give the links of a
   spanning star, never all pairs.

Postings longer than a block, in classes or bytes, are cut into blocks that all hold the posting's
pivots. The blocks of a posting whose classes have not become one component by that are then held
against each other, leaving out pairs of blocks of one component.

T lies six standard deviations below the number of equal coordinates at the threshold; a pair at the
threshold is missed with a probability of about 1e-9, one above it with less.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from collections.abc import Iterator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, words
from tessera.llm.bpe import gathered
from tessera.llm.exchange import column
from tessera.llm.rows import fresh
from tessera.plans.components import components
from tessera.plans.durable import durable
from tessera.plans.skew import grouped
from tessera.sources.tables import table

COORDINATES = 64
#: Classes of one posting, and bytes of their texts, that are compared in one place, and the pivots among them.
BLOCK, BLOCK_BYTES, PIVOTS = 1024, 8 << 20, 32
#: Stands for no posting; keys lie between -2**31 and COORDINATES * 2**32.
NO_KEY = -(1 << 62)
#: Rows of postings, and bytes of texts, that a task handles as one group, about.
BIN_ROWS, BIN_BYTES = 4_000, 4 << 20

_RNG = np.random.default_rng(20_231_105)
_XOR = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending numbers, ragged: (numbers, offsets).

    Shingles are runs of ``n`` words, A-Z taken as a-z. A text with fewer words has its whole
    sequence as its one shingle; one without words has none.
    """
    w = words.split(texts, lower=True)
    number, owner, counts = words.numbers(w), w.owner(), w.counts()
    found, of = [], []
    for k in range(1, n + 1):
        gram, at = words.grams(number, w, k)
        if k < n:
            whole = counts[owner[at]] == k
            gram, at = gram[whole], at[whole]
        found.append(gram)
        of.append(owner[at])
    gram, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])] if len(gram) else np.zeros(0, bool)
    return gram[new], np.r_[0, np.cumsum(np.bincount(of[new], minlength=len(counts)))]


def signatures(gram: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets that aren't empty: the value of each coordinate, and a 128-bit sum."""
    first = offsets[:-1][np.diff(offsets) > 0]
    if not len(first):
        return np.zeros((0, COORDINATES), np.int32), np.zeros((0, 2), np.int64)
    value = np.empty((len(first), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        value[:, c] = np.minimum.reduceat(((gram ^ _XOR[c]) * _MULTIPLY[c]) >> np.uint64(32), first)
    sums = [np.add.reduceat(words.mix(gram ^ x), first) for x in _XOR[:2]]
    return value.view(np.int32), np.stack(sums, axis=1).view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "_text"):
            gram, offsets = shingle_sets(part.column("_text"), n)
            sizes = np.diff(offsets)
            value, sums = signatures(gram, offsets)
            some = sizes > 0
            hi, lo = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            hi[some], lo[some] = sums[:, 0], sums[:, 1]
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some) * COORDINATES].astype(np.int32)), pa.array(value.ravel()))
            n_bytes = pc.fill_null(pc.binary_length(part.column("_text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(sizes, pa.int64()), n_bytes, pa.array(hi), pa.array(lo), listed],
                ["_id", "_n", "_bytes", "_hi", "_lo", "_sig"],
            )

    return rows.mapInArrow(sign, f"_id {kind}, _n long, _bytes long, _hi long, _lo long, _sig array<int>")


def least_matches(similarity: float) -> int:
    """Equal coordinates that a pair at the threshold has in all but one of about 1e9 cases."""
    spread = math.sqrt(COORDINATES * similarity * (1 - similarity))
    return max(1, math.floor(COORDINATES * similarity - 6 * spread))


def partnered(
    group: np.ndarray, coordinate: np.ndarray, sig: np.ndarray, prefix: np.ndarray, apart: np.ndarray, least: int
) -> np.ndarray:
    """Which rows have a partner in their group: another row with ``least`` equal coordinates.

    Rows are sorted by group. ``coordinate``: the one whose posting the group is. ``prefix``: for each
    row, which coordinates it is posted under; a pair counts at the lowest of those that it shares.
    ``apart``: two rows are held against each other only where its numbers differ (-1: always).
    """
    out = np.zeros(len(group), bool)
    rows, open_ = np.arange(len(group)), np.ones(len(group), bool)
    while len(rows):
        first = np.flatnonzero(np.r_[True, group[rows[1:]] != group[rows[:-1]]])
        size = np.diff(np.r_[first, len(rows)])
        at = np.minimum.reduceat(np.where(open_[rows], np.arange(len(rows)), len(rows)), first)  # the first open row of each group
        more = (at < len(rows)) & (size > 1)
        rows, at = rows[np.repeat(more, size)], rows[at[more]]
        size = size[more]
        if not len(rows):
            break
        hit = np.zeros(len(rows), bool)
        pivot = np.repeat(at, size)
        for a in range(0, len(rows), 50_000):
            i, j = pivot[a : a + 50_000], rows[a : a + 50_000]
            same = sig[i] == sig[j]
            near = (i != j) & (same.sum(axis=1) >= least) & ((apart[i] != apart[j]) | (apart[i] < 0))
            shared = same & prefix[i] & prefix[j]
            hit[a : a + 50_000] = near & (shared.argmax(axis=1) == coordinate[j])
        out[rows[hit]] = True
        out[pivot[hit]] = True
        open_[rows[hit]] = False
        open_[at] = False
        # A pivot that no row goes with is no one's partner.
        rows = rows[(rows != pivot) | out[rows]]
    return out


def linked(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the first one of its component, linking sets with 100 * common >= percent * union.

    ``known``: sets with equal numbers are in one component beforehand. Each set in turn is held
    against those that are in another component by then.
    """
    m = len(sets)
    size = np.array(list(map(len, sets)))
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    root = np.arange(m) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
    mine = np.zeros(len(every), bool)
    for i in range(m):
        other = np.flatnonzero((root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        if known is None:
            other = other[other > i]
        if not len(other):
            continue
        own = place[at[i] : at[i + 1]]
        mine[own] = True
        common = np.add.reduceat(mine[gathered(place, at[other], size[other])], np.r_[0, np.cumsum(size[other])[:-1]], dtype=np.int64)
        mine[own] = False
        tied = np.unique(root[other[100 * common >= percent * (size[i] + size[other] - common)]])
        if len(tied):
            root[np.isin(root, np.r_[tied, root[i]])] = min(int(tied[0]), int(root[i]))
    return root


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    block: int = BLOCK,
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept``: one row per row of ``docs``.

    Documents are linked when 100 * common shingles >= ``percent`` * shingles of either;
    ``component_id`` is the smallest id that links reach (nulls apart), ``kept`` whether it is the
    row's own. Documents without words have no shingles and stand alone. Repeated rows of an id have
    the same result. A null id counts as the largest: such a row is kept if nothing else is in its
    component. Other columns are ignored whatever their names.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100: signatures are too short below")
    signed = durable(_signed(docs, id_col, text_col, shingle_words))
    classes = durable(
        signed.where("_n > 0")
        .groupBy("_hi", "_lo", "_n")
        .agg(F.min("_id").alias("_rep"), F.max("_bytes").alias("_bytes"), F.first("_sig").alias("_sig"))
        .withColumn("_node", F.monotonically_increasing_id())
    )
    labels = components(_links(docs, classes, id_col, text_col, shingle_words, percent, block))
    rooted = classes.select("_hi", "_lo", "_n", "_node", "_rep").join(labels.withColumnRenamed("node", "_node"), "_node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "_node"))
    least = grouped(rooted, ["root"], F.min("_rep").alias("_component"))
    known = rooted.join(least, "root").select("_hi", "_lo", "_n", "_component")
    out = signed.select("_id", "_n", "_hi", "_lo").join(known, ["_hi", "_lo", "_n"], "left")
    component = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_component"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns: one document of each component.

    Rows are told apart by id and text; null ids come last in the order. Of rows alike in both, all
    stay or go together.
    """
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    gone = near_duplicates(keyed, "_key", "_text", shingle_words, percent).where(~F.col("kept")).select("_key").distinct()
    own = fresh(docs, "_row_key")
    marked = docs.withColumn(own, key)
    return marked.join(gone, marked[own].eqNullSafe(gone["_key"]), "left_anti").drop(own)


def prefixes(classes: DataFrame, least: int) -> DataFrame:
    """``_node``, ``key``, ``coordinate``, ``mask``: the postings to be merged, of two classes or more."""
    key = F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long")
    posted = classes.select("_node", "_bytes", F.posexplode("_sig").alias("coordinate", "value")).select("_node", "_bytes", key.alias("key"))
    repeated = grouped(posted, ["key"], F.count("*").alias("length")).where("length > 1")
    own = posted.join(repeated, "key").groupBy("_node", "_bytes").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("own"))
    rare = F.slice("own", F.lit(1), F.size("own") - least + 1)  # pairs that only this class has come before them
    # A key's value may be below 0, so the coordinate is that of the rounded key.
    coordinate = lambda k: F.shiftright(k + F.lit(1 << 31), 32).cast("int")
    rows = own.where(F.size("own") >= least).withColumn("rare", rare)
    mask = F.aggregate("rare", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), coordinate(x["key"]))))
    rows = rows.withColumn("mask", mask).select("_node", "_bytes", "mask", F.explode("rare.key").alias("key"))
    met = grouped(rows, ["key"], F.count("*").alias("members"), F.sum("_bytes").alias("all_bytes")).where("members > 1")
    return rows.join(met, "key").withColumn("coordinate", coordinate(F.col("key")))


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, percent: int, block: int) -> DataFrame:
    """Links (u, v) between nodes of ``classes`` that span every component."""
    least = least_matches(percent / 100)
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(block)), F.ceil(F.col("all_bytes") / F.lit(BLOCK_BYTES))).cast("int")
    met = durable(prefixes(classes, least).withColumn("blocks", F.least(blocks, F.col("members").cast("int"))).drop("all_bytes", "_bytes"))
    own = F.pmod(F.xxhash64("_node"), F.col("blocks")).cast("int")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("_node", F.lit(1)), F.col("members")) < PIVOTS)
    block_ = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    one = met.withColumn("a", block_).withColumn("b", F.col("a")).withColumn("apart", F.lit(-1).cast("long"))
    args = (docs, classes, id_col, text_col, n, percent, least)
    found = _confirmed(one.withColumn("pivot", F.when(F.col("blocks") > 1, pivot)), *args)
    split = met.where("blocks > 1")
    if split.isEmpty():
        return found.select("u", "v")
    found = durable(found)
    links = found.where("key is null").select("u", "v")
    # A component of a block goes by its smallest pivot, or else its root; a class without partner is one of its own.
    labels = grouped(found.where("key is not null").withColumnRenamed("u", "_node"), ["key", "_node"], F.min("v").alias("label"))
    split = split.join(labels, ["key", "_node"], "left").withColumn("apart", F.coalesce("label", "_node")).drop("label")
    whole = grouped(split, ["key", "apart"], F.count("*").alias("held"))
    several = grouped(whole, ["key"], F.count("*").alias("components")).where("components > 1")
    # A component with a block's worth of classes has blocks of its own; the others share blocks.
    left = split.join(whole, ["key", "apart"]).join(several.select("key"), "key", "left_semi")
    full = F.col("held") * F.col("blocks") >= F.col("members")
    unit = F.struct(
        F.when(full, F.col("apart")).alias("of"),
        F.pmod(F.xxhash64("_node"), F.when(full, F.ceil(F.col("held") * F.col("blocks") / F.col("members"))).otherwise(F.col("blocks"))).alias("at"),
    )
    left = durable(left.withColumn("unit", unit).drop("held"))
    units = left.select("key", "unit").distinct()
    x, y = units.select("key", F.col("unit").alias("x")), units.select("key", F.col("unit").alias("y"))
    meet = x.join(y, "key").where("x < y and not (x.of is not null and x.of <=> y.of) or x = y and x.of is null")
    number = meet.withColumn("b", F.xxhash64("x", "y"))
    sides = number.select("key", "b", F.col("x").alias("unit")).unionByName(number.select("key", "b", F.col("y").alias("unit"))).distinct()
    across = left.join(sides, ["key", "unit"]).drop("unit").withColumn("a", F.lit(-1)).withColumn("pivot", F.lit(None).cast("boolean"))
    return links.unionByName(_confirmed(across, *args).select("u", "v"))


def _confirmed(met: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, percent: int, least: int) -> DataFrame:
    """Links (``u``, ``v``) that span the components within each group (``key``, ``a``, ``b``) of ``met``; ``key`` is null.

    Where ``pivot`` isn't null, rows with a ``key`` besides: ``u`` a class, ``v`` the smallest pivot of
    its component in the group, or the component's root if it has none.
    """
    met = met.select("key", F.col("a").cast("int"), F.col("b").cast("long"), "_node", "coordinate", "mask", "apart", "pivot")
    bins = max(1, math.ceil(met.count() / BIN_ROWS))
    rows = met.join(classes.select("_node", "_sig"), "_node").withColumn("bin", F.pmod(F.xxhash64("key", "a", "b"), F.lit(bins)).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        get = lambda c: column(table, c).to_numpy(zero_copy_only=False)
        order = np.lexsort((get("b"), get("a"), get("key")))
        key, a, b = get("key")[order], get("a")[order], get("b")[order]
        sig = column(table, "_sig").flatten().to_numpy().reshape(-1, COORDINATES)[order]
        prefix = (get("mask")[order].view(np.uint64)[:, None] >> np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1)
        of = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        go = partnered(of, get("coordinate")[order], sig, prefix.astype(bool), get("apart")[order], least)
        names = ["key", "a", "b", "_node", "apart"]
        out = pa.table([pa.array(x[go]) for x in (key, a, b, get("_node")[order], get("apart")[order])], names=names)
        return out.append_column("pivot", column(table, "pivot").take(pa.array(order[go])))

    groups = durable(rows.groupBy("bin").applyInArrow(meet, "key long, a int, b long, _node long, apart long, pivot boolean"))
    needed = groups.select("_node").distinct().join(classes.select("_node", "_rep", "_hi"), "_node")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    text = text.join(needed, text["_id"].eqNullSafe(needed["_rep"])).select("_node", "_hi", "_text")
    size = groups.join(classes.select("_node", "_bytes"), "_node").agg(F.sum("_bytes")).first()[0] or 0
    bins = max(1, math.ceil(size / BIN_BYTES))
    to_confirm = groups.join(text, "_node").withColumn("bin", F.pmod(F.xxhash64("key", "a", "b"), F.lit(bins)).cast("int"))

    def confirm(table: pa.Table) -> pa.Table:
        get = lambda c: column(table, c).to_numpy(zero_copy_only=False)
        gram, offsets = shingle_sets(column(table, "_text"), n)
        size = np.diff(offsets)
        hi = np.zeros(len(size), np.int64)
        if len(gram):
            hi[size > 0] = np.add.reduceat(words.mix(gram ^ _XOR[0]), offsets[:-1][size > 0]).view(np.int64)
        node, key, a, b, apart = get("_node"), get("key"), get("a"), get("b"), get("apart")
        pivot, split = pc.fill_null(column(table, "pivot"), False).to_numpy(zero_copy_only=False), column(table, "pivot").is_valid().to_numpy(zero_copy_only=False)
        # An id may have rows with other texts; only those of the class count, once.
        order = np.lexsort((node, b, a, key))
        order = order[hi[order] == get("_hi")[order]]
        of = np.stack([key[order], a[order], b[order], node[order]])
        order = order[np.r_[True, (of[:, 1:] != of[:, :-1]).any(axis=0)]] if len(order) else order
        of = np.stack([key[order], a[order], b[order]])
        starts = np.flatnonzero(np.r_[True, (of[:, 1:] != of[:, :-1]).any(axis=0)]) if len(order) else order
        u, v, of_key = [], [], []
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            some = order[x:y]
            if len(some) < 2:
                continue
            known = apart[some]
            root = linked([gram[offsets[i] : offsets[i + 1]] for i in some.tolist()], percent, known if known[0] >= 0 else None)
            other = np.flatnonzero(root != np.arange(len(root)))
            u.append(node[some[other]])
            v.append(node[some[root[other]]])
            of_key.append(np.full(len(other), NO_KEY))
            if split[some[0]]:
                low = np.where(pivot[some], node[some], np.iinfo(np.int64).max)
                least_of = np.full(len(some), np.iinfo(np.int64).max)
                np.minimum.at(least_of, root, low)
                label = least_of[root]
                u.append(node[some])
                v.append(np.where(label < np.iinfo(np.int64).max, label, node[some[root]]))
                of_key.append(np.full(len(some), int(key[some[0]])))
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        of_key = cat(of_key)
        return pa.table([pa.array(cat(u), pa.int64()), pa.array(cat(v), pa.int64()), pa.array(of_key, pa.int64(), mask=of_key == NO_KEY)], names=["u", "v", "key"])

    return to_confirm.groupBy("bin").applyInArrow(confirm, "u long, v long, key long")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}

ORACLE_SQL = {
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM reach r JOIN u ON u.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.y, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
}
