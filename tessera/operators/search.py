"""The search table function: keywords, vectors, bit masks, order and paging over one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.operators import hybrid, knn, postings
from tessera.plans.sqlmini import Search


def run(
    q: Search,
    docs: DataFrame,
    posted: DataFrame,
    vectors: DataFrame | None = None,
    vectorize: Callable[[str, int], Sequence[float]] | None = None,
    field: str = "body",
    bits: str | None = "bits",
) -> DataFrame:
    """The rows of ``docs`` (by ``doc_id``) that a search finds, with ``distance``.

    All words of the keyword must occur in ``field``. With a text for the vector and a way to make one,
    the ``q.k`` nearest vectors (by cosine; columns ``doc_id`` and ``vec``) are held against the keyword's
    rows: those in both count, or the keyword's if there are none. Without any text, all rows count.
    Rows must pass the bit masks. They come by the order asked for, else by distance, then by id.
    """
    flags = (q.on_flag, q.off_flag, q.or_flags)
    rows = docs if bits is None else docs.where(B.passes(F.col(bits), *flags))
    found = rows.select("doc_id").withColumn("distance", F.lit(0.0))
    if words := q.keyword.lower().split():
        term = postings.Term().also(*[postings.Term(field, w) for w in dict.fromkeys(words)])
        hit = postings.search(posted, term, *flags)
        found = found.join(hit, "doc_id", "left_semi")
    if q.vector_query and vectors is not None and vectorize is not None:
        near = knn.nearest(vectors, vectorize(q.vector_query, q.vectorized_type), q.k, id_col="doc_id").select("doc_id", "distance")
        found = hybrid.with_fallback(near, found, "doc_id") if words else near.join(rows.select("doc_id"), "doc_id", "left_semi")
    out = rows.join(found, "doc_id")
    keys = [F.desc_nulls_first(c) if down else F.asc_nulls_last(c) for c, down in q.order] or [F.asc_nulls_last("distance")]
    out = out.orderBy(*keys, "doc_id")
    if q.offset:
        out = out.offset(q.offset)
    return out.limit(q.limit) if q.limit else out
