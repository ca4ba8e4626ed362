"""Schemas of the index tables."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()  # noqa: E741

CHUNKS = _s(("ord", L), ("chunk_id", S), ("file", S), ("pkg", S), ("symbol", S), ("kind", S), ("start_line", I), ("end_line", I), ("doc", S), ("signature", S), ("text", S))
POSTINGS = _s(("ord", L), ("term", S), ("tf", L), ("shard", I))
DOCLEN = _s(("ord", L), ("file", S), ("len", L))
DF = _s(("term", S), ("n", L))
STATS = _s(("n_docs", L), ("avgdl", D))
VERSIONS = _s(("number", L), ("version", S), ("model", S), ("dims", L), ("packages", B))
PACKAGES = _s(("name", S), ("dir", S), ("role", S))
EDGES = _s(("src", S), ("dst", S))
FILES = _s(("file", S), ("pkg", S), ("mtime_ms", D), ("n_lines", I), ("is_doc", B))
VECTORS = _s(("ord", L), ("embedding", T.ArrayType(T.FloatType())))
OPS = _s(("op_index", I), ("op_type", S), ("node_id", S), ("body", S), ("code", S), ("old_text", S), ("new_text", S), ("new_name", S), ("from_path", S), ("to_path", S), ("path", S), ("error", S))

INDEX = {"chunks": CHUNKS, "postings": POSTINGS, "doclen": DOCLEN, "df": DF, "stats": STATS, "edges": EDGES, "files": FILES, "vectors": VECTORS}
