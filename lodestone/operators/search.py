"""Ranked searches: BM25, dense cosine, symbol names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import explode_tokens, token_count, tokenize
from lodestone.functions.vector import dot, norm
from lodestone.operators.ranking import global_rank
from lodestone.tables import cut

K1, B = 1.5, 0.75
TOP = 80
#: Shards that the postings of a saved index are divided into by their terms.
SHARDS = 32


def shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def postings(chunks: DataFrame, key: str = "ord") -> DataFrame:
    """(key, term, tf): how often each chunk has each term."""
    return chunks.select(key, explode_tokens(F.col("text")).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_freq(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("n"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks and mean length in tokens (0 for no chunks)."""
    return chunks.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(token_count(F.col("text"))), F.lit(0.0)).alias("avgdl"))


def query_terms(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    return texts.select(*keys, F.explode(F.array_distinct(tokenize(F.col(text_col)))).alias("term"))


def _score(tf: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """(ord, file, score) from (ord, file, len, term, tf), (term, n) and one row of (n_docs, avgdl)."""
    # One row: broadcasting it is bounded by its form.
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return scored.withColumn("part", part).groupBy("ord", "file").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")


def bm25(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(ord, file, score) of every chunk with a term of one query; `batch` searches for many queries.

    Only terms of the query leave the tokenizer: the corpus is never exploded whole. They are
    few, so the texts are tokenized once, for the lengths and the hits. What is left is
    written once and read for the frequencies and for the scores.
    """
    wanted = terms.agg(F.collect_set("term").alias("wanted"))  # the terms of one query
    tokens = chunks.select("ord", "file", tokenize(F.col("text")).alias("t")).crossJoin(F.broadcast(wanted))
    found = cut(tokens.select("ord", "file", F.size("t").cast("long").alias("len"), F.filter("t", lambda t: F.array_contains("wanted", t)).alias("hits")))
    tf = found.select("ord", "file", "len", F.explode("hits").alias("term")).groupBy("ord", "file", "len", "term").agg(F.count("*").alias("tf"))
    stats = found.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    return _score(tf, tf.groupBy("term").agg(F.count("*").alias("n")), stats)


def bm25_indexed(index: dict[str, DataFrame], terms: DataFrame) -> DataFrame:
    """(ord, file, score) from the postings of a saved index, for the terms of one query.

    The terms are literals in the filter, so that only their shards of the postings and their
    row groups are read; no text is. Frequencies, lengths and the corpus row are stored too.
    """
    rows = terms.select("term", shard(F.col("term")).alias("shard")).distinct().collect()  # the terms of one query
    words, shards = sorted(r["term"] for r in rows), sorted({r["shard"] for r in rows})
    own = index["postings"].where(F.col("shard").isin(shards) & F.col("term").isin(words)).select("ord", "term", "tf")
    df = index["df"].where(F.col("term").isin(words)).select("term", "n")
    return _score(own.join(index["doclen"], "ord"), df, index["stats"])


def dense(chunks: DataFrame, vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(ord, file, score): cosine of every vector with the query's, one row (q)."""
    v = vectors.crossJoin(F.broadcast(query.limit(1)))
    score = F.round(dot(F.col("embedding"), F.col("q")) / (norm(F.col("embedding")) * norm(F.col("q"))), 6)
    return v.select("ord", score.alias("score")).join(chunks.select("ord", "file"), "ord").select("ord", "file", "score")


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    return scored.orderBy(F.desc("score"), "ord").limit(k)


def ranked_files(topped: DataFrame, *keys: str) -> DataFrame:
    """(keys, file, rank): files of a short ranked list, each at its best chunk, ranked anew."""
    best = topped.groupBy(*keys, "file").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord")).alias("at"))
    return best.select(*keys, "file", F.row_number().over(Window.partitionBy(*keys).orderBy("at")).cast("long").alias("rank"))


def symbol_scores(symbols: DataFrame, task: DataFrame) -> DataFrame:
    """(file, id, score): one for each name token that the query has, two if the query contains the name."""
    q = task.select(F.lower("task").alias("q_text"), tokenize(F.col("task")).alias("q_tokens"))
    s = symbols.where("kind <> 'doc'").crossJoin(F.broadcast(q.limit(1)))
    tokens = F.size(F.filter(tokenize(F.col("name")), lambda t: F.array_contains(F.col("q_tokens"), t)))
    named = F.when((F.length("name") >= 3) & F.contains("q_text", F.lower("name")), 2).otherwise(0)
    return s.select("file", "id", "start_line", (tokens + named).cast("long").alias("score")).where("score > 0")


def symbol_files(scores: DataFrame) -> DataFrame:
    """(file, score, rank): best symbol of each file; ties by file."""
    best = scores.groupBy("file").agg(F.max("score").alias("score"))
    return global_rank(best, F.desc("score"), F.asc("file"))
