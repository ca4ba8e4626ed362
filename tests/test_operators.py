import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, vector
from lodestone.functions.text import token_count, tokenize, word_tokens
from lodestone.operators import batch, edits, evaluation, fusion, graph, maintenance, search, structure
from lodestone.operators import manifest as man
from lodestone.operators.ranking import global_rank
from lodestone.plans import queries


def _one(spark, column, *values):
    return spark.createDataFrame([values], ["a", "b", "c", "d"][: len(values)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("buildIndex", ["buildindex", "build", "index"]),
        ("HTTPServer parseJSON2Xml", ["httpserver", "http", "server", "parsejson2xml", "parse", "json2", "xml"]),
        ("snake_case_name", ["snake", "case", "name"]),
        ("the constVALUE X", ["constvalue", "value"]),
        ("constructor", ["constructor"]),
        ("élan vital", ["lan", "vital"]),
        ("", []),
        ("aB the THE aTheB", ["ab", "atheb"]),
        ("x\u0001y2Z \u0004ok", ["y2z", "y2", "ok"]),
    ],
)
def test_tokenize(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(tokenize(F.col("t")).alias("x"), token_count(F.col("t")).alias("n")).first()
    assert row["x"] == expected
    assert row["n"] == len(expected)


def test_tokenize_null(spark):
    row = spark.createDataFrame([(None,)], "t string").select(tokenize(F.col("t")).alias("x"), token_count(F.col("t")).alias("n")).first()
    assert row["x"] is None and row["n"] == 0


def _chunks(spark):
    return spark.createDataFrame([(1, "f1", "red ring red"), (2, "f2", "ring bolt"), (3, "f3", "bolt bolt gear plate")], "ord long, file string, text string")


@pytest.mark.parametrize("q, expected", [("red ring red", {1: 1.871188, 2: 0.552945}), ("bolt", {2: 0.552945, 3: 0.606456}), ("nothing", {})])
def test_bm25(spark, q, expected):
    terms = search.query_terms(spark.createDataFrame([(q,)], "task string"), "task")
    assert {r["ord"]: r["score"] for r in search.bm25(_chunks(spark), terms).collect()} == pytest.approx(expected)


def test_bm25_of_an_empty_corpus(spark):
    terms = search.query_terms(spark.createDataFrame([("red",)], "task string"), "task")
    assert search.bm25(_chunks(spark).limit(0), terms).count() == 0


@pytest.mark.parametrize("word", ["buildIndex", "HTTPServer", "parseJSON2Xml", "constVALUE", "X", "THE", "aB", "aTheB", "y2Z", "ABc", "A1b", "aBCd", "ABCDe9F"])
def test_tokens_of_a_word(spark, word):
    assert word_tokens(word) == _one(spark, tokenize(F.col("a")), word)


@pytest.mark.parametrize("limit", [10**6, 7])
def test_best_files_of_many_queries(spark, monkeypatch, limit):
    for name in ("BLOCK_TERMS", "CHARS", "WORDS", "CELLS"):  # with 7: many passes, few texts and chunks at once
        monkeypatch.setattr(batch, name, limit)
    words = ["red", "ring", "Bolt", "gearBox", "plate"]
    rows = [(i, None if i % 11 == 0 else f"f{i % 7}", " ".join(words[: 1 + i % 5] * (1 + i % 3)) if i % 13 else "") for i in range(60)]
    chunks = spark.createDataFrame(rows, "ord long, file string, text string").repartition(3)
    tasks = spark.createDataFrame([(f"q{i}", f"{words[i]} {words[(i + 2) % 5]} absent") for i in range(5)], "item string, task string")
    got = {(r["item"], r["file"]): r["at"] for r in batch.best_files(chunks, search.query_terms(tasks, "task", "item"), "item", 3).groupBy("item", "file").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord")).alias("at")).collect()}
    for t in tasks.collect():
        one = {}
        for r in search.bm25(chunks, search.query_terms(tasks.where(F.col("item") == t["item"]), "task")).collect():
            one[r["file"]] = min(one.get(r["file"], (0, 0)), (-r["score"], r["ord"]))
        own = {f: (at["s"], at["ord"]) for (q, f), at in got.items() if q == t["item"]}
        assert sorted(own.values())[:3] == sorted(one.values())[:3]
        assert {f for f, _ in sorted(own.items(), key=lambda x: x[1])[:3]} == {f for f, _ in sorted(one.items(), key=lambda x: x[1])[:3]}


def test_best_files_of_no_query_or_chunk(spark):
    terms = search.query_terms(spark.createDataFrame([(1, "red")], "item long, task string"), "task", "item")
    assert batch.best_files(_chunks(spark).limit(0), terms, "item", 3).count() == 0
    assert batch.best_files(_chunks(spark), terms.limit(0), "item", 3).count() == 0


@pytest.mark.parametrize("name", ["bm25_batch", "eval_metrics", "eval_metrics_files"])
def test_batch_shuffles_no_row_for_each_query_and_chunk(spark, tmp_path, name):
    c = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("p/q/f"), F.col("id") % 300).alias("file"), F.lit("p").alias("pkg"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat(F.lit("red ring word"), "id").alias("text"))
    c.write.parquet(f"{tmp_path}/chunks.parquet")
    spark.range(20).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("x").alias("layer"), F.concat(F.lit("red ring task"), "id").alias("task"), F.array(F.lit("p/q/f1")).alias("expect")).write.parquet(f"{tmp_path}/eval_items.parquet")
    sc = spark.sparkContext
    written = lambda: sum(x.shuffleWriteRecords() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)))
    before = written()
    assert queries.queries()[name](spark, str(tmp_path)).count() > 0
    assert 0 < written() - before < 3000 * 20 / 2


@pytest.mark.parametrize("name, passed", [("eval_metrics", (20, 20, 0.0, 1.0)), ("eval_metrics_files", (20, 20, 1.0, 0.5))])
def test_metrics_shuffle_no_row_for_each_query_and_chunk(spark, tmp_path, name, passed):
    c = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("p/q/f"), F.col("id") % 300).alias("file"), F.lit("p").alias("pkg"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat(F.lit("red ring word"), "id").alias("text"))
    c.write.parquet(f"{tmp_path}/chunks.parquet")
    spark.range(20).select(F.col("id").alias("item_id"), F.lit("x").alias("layer"), F.concat(F.lit("red ring task"), "id").alias("task"), F.array(F.lit("p/q/f1")).alias("expect")).write.parquet(f"{tmp_path}/eval_items.parquet")
    sc = spark.sparkContext
    stages = lambda: list(sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)))
    before = max([-1, *(x.stageId() for x in stages())])
    # All columns are asked for: a count of the layers needs no rank, and Spark leaves the search out of it.
    assert [tuple(r)[1:] for r in queries.queries()[name](spark, str(tmp_path)).collect()] == [passed]
    assert 20 * 80 <= sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > before) < 3000 * 20 / 2


def test_rrf_ties_by_first_place(spark):
    lists = [spark.createDataFrame([(f, i) for i, f in enumerate(x, 1)], "file string, rank long") for x in ("abc", "bd", "da")]
    got = fusion.rrf(lists).orderBy(F.desc("score"), "list", "rank").collect()
    assert [r["file"] for r in got] == ["a", "b", "d", "c"]
    assert got[0]["score"] == got[2]["score"] == pytest.approx(0.032522475, abs=1e-8)


def test_symbol_scores(spark):
    names = ["acceptBid", "BidService.accept", "bids", "bidBid", "id"]
    s = spark.createDataFrame([(str(i), n, "function", f"f{i}", 1) for i, n in enumerate(names)], "id string, name string, kind string, file string, start_line int")
    task = spark.createDataFrame([("acceptBid for bids service",)], "task string")
    got = {r["id"]: r["score"] for r in search.symbol_scores(s, task).collect()}
    assert got == {"0": 5, "1": 3, "2": 3, "3": 2}


def test_expand(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "d"), ("e", "b")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "pos long, file string")
    got = [(r["hop"], r["file"], r["reason"]) for r in graph.expand(seeds, edges, 2).orderBy("hop", "pos").collect()]
    assert got == [(1, "b", "imported-by-seed"), (1, "c", "imports-seed"), (2, "d", "imported-by-seed"), (2, "e", "imports-seed")]
    assert graph.expand(seeds, edges, 0).count() == 0
    assert graph.reverse(graph.reverse(edges)).exceptAll(edges).count() == 0


PACKAGES = [("backend", "apps/backend", "backend"), ("frontend", "apps/frontend", "frontend"), ("mobile", "apps/mobile", "mobile"), ("@scope/shared", "packages/shared", "shared")]


@pytest.mark.parametrize(
    "q, static, expected",
    [
        ("rename a variable in some file", {}, {"backend": 1, "frontend": 1, "mobile": 1}),
        ("wrap the route in a db transaction and update the schema atomically", {}, {"backend": 1.6, "frontend": 1.12, "mobile": 1}),
        ("nothing layer-specific here", {"backend": 1.3, "mobile": 0.9}, {"backend": 1.3, "mobile": 0.9, "frontend": 1}),
        ("db transaction schema migration atomic route", {"backend": 1.2}, {"backend": 1.92}),
    ],
)
def test_package_weights(spark, q, static, expected):
    terms = search.query_terms(spark.createDataFrame([(q,)], "task string"), "task")
    roles = spark.createDataFrame(PACKAGES, "name string, dir string, role string")
    got = {r["name"]: r["weight"] for r in fusion.package_weights(roles, fusion.layer_hits(spark, terms), static).collect()}
    assert {k: got[k] for k in expected} == pytest.approx(expected)


def test_weighting_off(spark):
    terms = search.query_terms(spark.createDataFrame([("db transaction",)], "task string"), "task")
    roles = spark.createDataFrame(PACKAGES, "name string, dir string, role string")
    assert {r["weight"] for r in fusion.package_weights(roles, fusion.layer_hits(spark, terms), enabled=False).collect()} == {1.0}


def test_roles_by_dependency(spark):
    p = spark.createDataFrame([("a", "w", None), ("b", "w", None), ("c", "w", "unknown"), ("d", "w", None)], "name string, dir string, role string")
    deps = spark.createDataFrame([("a", "elysia"), ("a", "drizzle-orm"), ("b", "next"), ("b", "react-dom"), ("c", "expo"), ("c", "react-dom"), ("d", "typescript")], "name string, dep string")
    assert {r["name"]: r["role"] for r in fusion.infer_roles(p, deps).collect()} == {"a": "backend", "b": "frontend", "c": "mobile", "d": "unknown"}


def test_sections(spark):
    docs = spark.createDataFrame([("r.md", "intro\n# A\nx\n#### deep\n## B"), ("blank.md", "\n\n# T\r\nbody")], "file string, content string")
    got = {(r["file"], r["title"], r["start_line"], r["end_line"]) for r in structure.sections(docs).collect()}
    assert got == {("r.md", "r.md", 1, 1), ("r.md", "A", 2, 4), ("r.md", "B", 5, 5), ("blank.md", "T", 3, 4)}


def test_owners(spark):
    files = spark.createDataFrame([("apps/a/x.ts",), ("apps/ab/x.ts",), ("top.ts",)], "file string")
    pk = spark.createDataFrame([("root", "."), ("a", "apps/a"), ("apps", "apps")], "name string, dir string")
    assert {r["file"]: r["owner"] for r in structure.owners(files, pk).collect()} == {"apps/a/x.ts": "a", "apps/ab/x.ts": "apps", "top.ts": "root"}


def test_whole_file_and_tokens(spark):
    f = spark.createDataFrame([("a", 50), ("b", 51), ("c", None)], "file string, n_lines int")
    assert {r["file"]: r["whole"] for r in man.whole_file(f).collect()} == {"a": True, "b": False, "c": False}
    assert _one(spark, evaluation.chars_to_tokens(F.col("a")), 4) == 1
    assert _one(spark, evaluation.chars_to_tokens(F.col("a")), 6) == 2
    assert _one(spark, evaluation.estimate_tokens(F.col("a")), "") == 1


@pytest.mark.parametrize(
    "node, expected",
    [("src/a.ts#meth_C.m~2", ("src/a.ts", "meth", "C.m", 2)), ("src/a.ts#fn_my_func", ("src/a.ts", "fn", "my_func", 0)), ("src/a.ts", None), ("src/a.ts#zz_name", None), ("a.ts#fn_", None), ("a.ts#fn_x~", ("a.ts", "fn", "x", 0))],
)
def test_node_id(spark, node, expected):
    got = _one(spark, paths.parse_node_id(F.col("a")), node)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("glob, path, hit", [("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/?.ts", "src/a.ts", True), ("src/**", "src/a/b", True), ("a.ts", "abts", False)])
def test_globs(spark, glob, path, hit):
    assert _one(spark, paths.matches_any(F.col("a"), [glob]), path) is hit


def test_file_suffix(spark):
    names = {"index.ts": "index", "foo.service.ts": ".service.ts", "Bar.tsx": ".tsx", "README": "README", "a.md": ".md"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", paths.file_suffix(F.col("n")).alias("s")).collect()} == names


STREAM = """talk
STRUCTURAL_EDIT: a.ts#fn_f

ACTION: replace_text
OLD:
x = 1
NEW:
x = 2

CRITICAL_REFACTOR: RENAME a.ts#fn_f TO g
MOVE_FILE: a.ts TO b.ts
CREATE_FILE: c.ts
CODE:
let y
DELETE_FILE: d.ts
"""


def test_parse_ops(spark):
    df = spark.createDataFrame([(1, STREAM), (2, "MOVE_FILE: a.ts"), (3, None), (4, "nothing")], "id long, t string")
    got = edits.parse_ops(df, "id", "t").orderBy("id", "op_index").collect()
    assert [(r["id"], r["op_type"]) for r in got] == [(1, "REPLACE_TEXT"), (1, "RENAME"), (1, "MOVE_FILE"), (1, "CREATE_FILE"), (1, "DELETE_FILE"), (2, "ERROR")]
    assert (got[0]["old_text"], got[0]["new_text"], got[1]["new_name"], got[2]["to_path"], got[3]["code"]) == ("x = 1", "x = 2", "g", "b.ts", "let y")


@pytest.mark.parametrize("text, old, new, expected", [("a b c", "b", "x$1", "a x$1 c"), ("a b b", "b", "x", None), ("abc", "z", "x", None), ("aaa", "aa", "x", None), ("abc", "", "x", None)])
def test_replace_unique(spark, text, old, new, expected):
    assert _one(spark, edits.replace_unique(F.col("a"), F.col("b"), F.col("c")), text, old, new) == expected


def test_guards_and_diffs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "b")], "src string, dst string")
    f = spark.createDataFrame([("a",), ("b",)], "file string")
    assert {r["file"]: r["allowed"] for r in edits.delete_guard(f, edges).collect()} == {"a": True, "b": False}
    moved = edits.move_files(edges, spark.createDataFrame([("b", "z")], "from_path string, to_path string"))
    assert {tuple(r) for r in moved.collect()} == {("a", "z"), ("z", "z")}
    before = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    after = spark.createDataFrame([("a", 2), ("b", None), ("d", 1)], "k string, v int")
    assert {tuple(r) for r in edits.snapshot_diff(before, after, "k", "v").collect()} == {("a", "changed"), ("c", "deleted"), ("d", "added")}
    d = lambda *rows: spark.createDataFrame(list(rows), "file string, line int, code int, message string")
    assert [r["line"] for r in edits.new_diagnostics(d(("a", 1, 7, "m")), d(("a", 9, 7, "m"), ("a", 3, 8, "m"))).collect()] == [3]


def test_incremental_update_equals_rebuild(spark):
    old = spark.createDataFrame([(1, "a", "red ring"), (2, "b", "old words here")], "ord long, file string, text string")
    fresh = spark.createDataFrame([(3, "b", "new words")], "ord long, file string, text string")
    merged = maintenance.upsert(search.postings(old.select("ord", "text")).join(old.select("ord", "file"), "ord"), search.postings(fresh.select("ord", "text")).join(fresh.select("ord", "file"), "ord"), fresh)
    rebuilt = search.doc_freq(search.postings(old.where("file = 'a'").unionByName(fresh)))
    assert {tuple(r) for r in search.doc_freq(merged.select("ord", "term", "tf")).collect()} == {tuple(r) for r in rebuilt.collect()}
    assert "old" not in {r["term"] for r in rebuilt.collect()}


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "c", "a.ts", "p", "f", "function", 1, 2, None, None, "alpha beta")], maintenance.schemas.CHUNKS)
    files = spark.createDataFrame([("a.ts", "p", 1.0, 2, False)], maintenance.schemas.FILES)
    edges = spark.createDataFrame([("a.ts", "b.ts")], maintenance.schemas.EDGES)
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], maintenance.schemas.VECTORS)
    index = maintenance.build(chunks, vectors, edges, files)
    root = f"file://{tmp_path}/index"
    first = maintenance.save(spark, index, root, "m", 2)
    assert maintenance.save(spark, index, root, "m", 2) != first
    got = maintenance.load(spark, root, "m", 2)
    assert {r["term"] for r in got["postings"].collect()} == {"alpha", "beta"}
    with pytest.raises(ValueError):
        maintenance.load(spark, root, "other", 2)
    with pytest.raises(FileNotFoundError):
        maintenance.load(spark, f"file://{tmp_path}/none", "m", 2)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(vector.cosine(F.col("a"), F.col("b")).alias("c"), vector.norm(vector.l2_normalize(F.col("a"))).alias("n"), vector.max_abs_diff(F.col("a"), F.col("b")).alias("m")).collect()
    assert got[0]["c"] == pytest.approx(0.96) and got[0]["n"] == pytest.approx(1) and got[0]["m"] == 1
    assert got[1]["c"] is None and got[1]["n"] == 0


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = global_rank(df, F.desc("v")).collect()
    assert all(r["rank"] == 1000 - r["v"] for r in got) and len(got) == 1000


def test_metrics(spark):
    items = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["c"]), (3, "y", ["z"])], "item_id long, layer string, expect array<string>")
    ranked = spark.createDataFrame([(1, "q", 1), (1, "b", 2), (1, "a", 3), (2, "c", 1)], "item_id long, file string, rank long")
    got = {r["layer"]: tuple(r)[1:] for r in evaluation.metrics(evaluation.ranks(ranked, items, 8)).collect()}
    assert got == {"x": (2, 2, 0.5, 0.75), "y": (1, 0, None, 0.0)}


def test_alias_loop_ends(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")
    got = {r["name"]: (r["target"], r["steps"]) for r in graph.follow_aliases(a).collect()}
    assert got["a"] == ("c", 2) and got["b"] == ("c", 1) and got["x"][1] == 6


def test_event_windows_over_files_in_mixed_order(spark, tmp_path):
    import os
    import time

    from lodestone.streaming.ingest import event_windows

    began, now = datetime.datetime(2026, 1, 1), time.time()
    (tmp_path / "events.parquet").mkdir()
    for place, hour in enumerate([90, 5, 70, 20, 99, 0, 60, 10, 40, 30]):
        rows = [(began + datetime.timedelta(hours=hour, minutes=10 * m), "run", 0.5) for m in range(9)] + [(None, "run", 1.0)]
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "one" / str(place)))
        part = next((tmp_path / "one" / str(place)).glob("*.parquet"))
        target = tmp_path / "events.parquet" / f"part-{place}.parquet"
        part.rename(target)
        os.utime(target, (now - 1000 + place, now - 1000 + place))
    got = {r["window_start"]: (r["n"], r["total"]) for r in event_windows(spark, str(tmp_path)).collect()}
    want = {began + datetime.timedelta(hours=h + i): ((6, 3.0), (3, 1.5))[i] for h in (90, 5, 70, 20, 99, 0, 60, 10, 40, 30) for i in (0, 1)}
    assert got == want | {None: (10, 10.0)}
