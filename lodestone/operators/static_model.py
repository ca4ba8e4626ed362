"""A static embedding learned from an index: each token has a vector, a text is the weighted mean of its tokens' vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vector import l2_normalize


def _mean(rows: DataFrame, by: str, vector: str, dims: int, weight: str | None = None) -> DataFrame:
    """(by, vector): means of the components; sums are combined before the shuffle, and no list of vectors is ever gathered."""
    w = F.col(weight) if weight else F.lit(1.0)
    part = lambda i: F.sum(F.col(vector)[i].cast("double") * w) / F.sum(w)
    return rows.groupBy(by).agg(F.array(*[part(i) for i in range(dims)]).alias(vector))


def learn(post: DataFrame, vectors: DataFrame, dims: int, terms: DataFrame | None = None) -> DataFrame:
    """(term, vector, weight): the mean vector of the chunks that have a term, weighted less the more chunks have it.

    `post` are postings (ord, term), `vectors` (ord, embedding). With `terms` only theirs are
    learned. A term without a chunk that has a vector is left out.
    """
    own = post.select("ord", "term").distinct()
    own = own.join(terms.select("term").distinct(), "term", "left_semi") if terms is not None else own
    own = own.join(vectors.select("ord", F.col("embedding").alias("vector")), "ord")
    weights = own.groupBy("term").agg((1 / (1 + F.log(F.count("*").cast("double")))).alias("weight"))
    return _mean(own, "term", "vector", dims).join(weights, "term")


def embed(terms: DataFrame, key: str, model: DataFrame, dims: int) -> DataFrame:
    """(key, vector) of unit length for (key, term); a text without a known token has no row. Repeated terms count once."""
    known = terms.select(key, "term").distinct().join(model, "term")
    return _mean(known, key, "vector", dims, "weight").select(key, l2_normalize(F.col("vector")).alias("vector"))
