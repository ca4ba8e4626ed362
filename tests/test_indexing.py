"""Declarations, imports, adjacency and the saved index on hand-made cases."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.functions.code import symbols_of
from lodestone.functions.paths import normalised
from lodestone.operators import edits, fusion, graph, indexing, maintenance, search, static_model, structure

CODE = """/**
 * @license thing 1.0
 */

import { a } from "./a";

/** Lists doors. */
@Injectable()
export abstract class Door<T> extends Base {
  private n = 1;
  constructor() { super(); }
  get width() { return 1; }
  // Opens it.
  async open(x: number): Promise<void> {
    if (x) { return; }
  }
}
export interface Hinge { a: string }
export type Latch =
  | "a"
  | "b";
export enum Lock { On, Off }
const hidden = 1;
export const table = [
  1,
];
export const arrow = async (x: {
  a: string;
}) => x;
const text = `
export function never() {}
`;
function over(a: string): void;
function over(a: any) {}
"""


def test_symbols():
    got = [(s.name, s.kind, s.start_line, s.end_line) for s in symbols_of(CODE)]
    assert got == [("Door", "class", 7, 17), ("Door.open", "method", 14, 16), ("Hinge", "interface", 18, 18), ("Latch", "type", 19, 21), ("Lock", "enum", 22, 22), ("table", "const", 24, 26), ("arrow", "function", 27, 29), ("over", "function", 33, 34)]
    by = {s.name: s for s in symbols_of(CODE.replace("\n", "\r\n"))}
    assert by["Door"].doc == "Lists doors." and by["Door.open"].doc == "Opens it." and by["Hinge"].doc is None
    assert by["arrow"].signature == "export const arrow = async (x: {" and [(s.start_line, s.end_line) for s in by.values()] == [(a, b) for *_, a, b in got]
    assert symbols_of(None) == symbols_of("") == []


def test_extract_and_chunks(spark):
    df = spark.createDataFrame([("a/x.ts", CODE), ("a/x.md", "# T\nbody"), ("b.ts", None), ("c.ts", "")], "file string, content string").withColumn("name", F.lit(1))
    packages = spark.createDataFrame([("p", "a", None)], "name string, dir string, role string")
    assert indexing.extract_symbols(df).count() == 8 and indexing.extract_symbols(df.limit(0)).count() == 0
    got = indexing.chunks_of(df, packages, 9, "first").orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(10, 19)) and {r["pkg"] for r in got if r["kind"] != "doc"} == {"p"}
    assert [r["symbol"] for r in got][1:] == ["arrow", "over", "Door", "Door.open", "Hinge", "Latch", "Lock", "table"]
    assert {r["file"]: r["owner"] for r in structure.owners(df, packages, "first").collect()} == {"a/x.ts": "p", "a/x.md": "p", "b.ts": "first", "c.ts": "first"}


@pytest.mark.parametrize("path, out", [("a/b/../c", "a/c"), ("./a//b/.", "a/b"), ("../../a", "a"), ("a/..", ""), ("", "")])
def test_normalised(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(normalised(F.col("p")).alias("x")).first()["x"] == out


IMPORTS = """import one, { two as deux, type Three } from "./lib";
import * as all from "../top";
import type { Four } from '@s/p/deep';
import "./effects";
import {
  five,
  six,
} from "@/root/five";
export { seven as sept } from "./lib";
export * from "./lib";
export * as ns from "./lib";
export const kind = "import { not } from 'here'";
"""


def test_import_forms(spark):
    df = spark.createDataFrame([("d/x.ts", IMPORTS), ("e.ts", None)], "file string, content string")
    got = {(r["spec"], r["name"], r["exported"]) for r in graph.statements(df).collect()}
    assert got == {
        ("./lib", "default", None), ("./lib", "two", None), ("./lib", "Three", None), ("../top", "*", None), ("@s/p/deep", "Four", None), ("./effects", "", None), ("@/root/five", "five", None), ("@/root/five", "six", None),
        ("./lib", "seven", "sept"), ("./lib", "*", "*"), ("./lib", "*", "ns"),
    }
    at = {r["spec"]: r["path"] for r in graph.module_paths(graph.statements(df)).collect()}
    assert at == {"./lib": "d/lib", "../top": "top", "@s/p/deep": None, "./effects": "d/effects", "@/root/five": "root/five"}


def test_import_targets(spark):
    files = spark.createDataFrame([(f,) for f in ("a.ts", "lib/index.ts", "lib/one.ts", "lib/two.ts", "util.ts", "p/x.ts", "p/y.ts")], "file string")
    imports = [("a.ts", "./lib", "One"), ("a.ts", "./lib", "Two"), ("a.ts", "./lib", "Own"), ("a.ts", "./util", "u"), ("a.ts", "@s/p", "X"), ("a.ts", "@s/p/sub", "Y"), ("a.ts", "@s/pq", "X"), ("a.ts", "react", "r"), ("a.ts", "./a", "self")]
    out = [("lib/index.ts", "./one", "Inner", "One"), ("lib/index.ts", "./two", "*", "*"), ("lib/one.ts", "./two", "Deep", "Inner")]
    index = graph.symbol_index(spark.createDataFrame([("@s/p", "X", "class", "p/x.ts"), ("@s/p", "Y", "type", "p/y.ts"), ("@s/p", "Y", "type", "p/x.ts"), ("l", "Two", "const", "lib/two.ts"), ("l", "Own", "const", "lib/index.ts"), ("l", "m", "method", "lib/two.ts")], "pkg string, name string, kind string, file string"))
    packages = spark.createDataFrame([("@s/p",), ("@s",)], "name string")
    got = {(r["spec"], r["name"], r["target"], r["stage"]) for r in graph.import_targets(
        spark.createDataFrame(imports, "src string, spec string, name string"), spark.createDataFrame(out, "src string, spec string, name string, exported string"), files, packages, index).collect()}
    assert got == {("./lib", "One", "lib/two.ts", 0), ("./lib", "Two", "lib/two.ts", 0), ("./lib", "Own", "lib/index.ts", 0), ("./util", "u", "util.ts", 1), ("@s/p", "X", "p/x.ts", 3), ("@s/p/sub", "Y", "p/x.ts", 3), ("@s/p/sub", "Y", "p/y.ts", 3)} or \
        got == {("./lib", "One", "lib/two.ts", 0), ("./lib", "Two", "lib/two.ts", 0), ("./lib", "Own", "lib/index.ts", 2), ("./util", "u", "util.ts", 1), ("@s/p", "X", "p/x.ts", 3), ("@s/p/sub", "Y", "p/x.ts", 3), ("@s/p/sub", "Y", "p/y.ts", 3)}


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", x) for x in "dcb"] + [("b", "a"), ("b", "a")], "src string, dst string")
    assert sorted(map(tuple, graph.neighbours(edges, "src", "dst").collect())) == [("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d"), ("b", 1, "a")]
    assert graph.neighbours(edges.limit(0), "src", "dst").count() == 0


def test_roles_by_compiler_options(spark):
    p = spark.createDataFrame([("a", "x/web", None), ("b", "x", None), ("c", "x", None), ("d", "x/server", None)], "name string, dir string, role string")
    deps = spark.createDataFrame([("c", "expo")], "name string, dep string")
    options = spark.createDataFrame([("a", "types", "node"), ("a", "lib", "dom"), ("b", "lib", "DOM.Iterable"), ("c", "types", "node"), ("d", "types", "jest")], "name string, option string, value string")
    assert {r["name"]: r["role"] for r in fusion.infer_roles(p, deps, options).collect()} == {"a": "backend", "b": "frontend", "c": "mobile", "d": "backend"}


def _index(spark, texts):
    chunks = spark.createDataFrame([(i, str(i), f"f{i % 3}.ts", "p", "f", "function", 1, 2, None, None, t) for i, t in enumerate(texts)], maintenance.schemas.CHUNKS)
    files = spark.createDataFrame([(f"f{i}.ts", "p", 1.0, 2, False) for i in range(3)], maintenance.schemas.FILES)
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(len(texts))], maintenance.schemas.VECTORS)
    return chunks, vectors, spark.createDataFrame([("f0.ts", "f1.ts"), ("f1.ts", "f2.ts")], maintenance.schemas.EDGES), files


def test_indexed_search_prunes_and_equals_the_plain_one(spark, tmp_path):
    parts = _index(spark, ["red ring", "blue ring bolt", "gear", "red red gear", ""])
    root = f"file://{tmp_path}/index"
    assert not maintenance.exists(spark, root)
    maintenance.save(spark, maintenance.build(*parts), root, dims=2)
    assert maintenance.exists(spark, root)
    terms = search.query_terms(spark.createDataFrame([("red gear nothing",)], "task string"), "task")
    plan = search.bm25_indexed(maintenance.load(spark, root, dims=2), terms)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, search.bm25(parts[0], terms).collect()))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in text and "In(term" in text


def test_an_update_equals_a_new_index(spark, tmp_path):
    chunks, vectors, edges, files = _index(spark, ["red ring", "blue ring bolt", "gear", "red red gear"])
    root = f"file://{tmp_path}/index"
    maintenance.save(spark, maintenance.build(chunks, vectors, edges, files), root, dims=2)
    old = maintenance.load(spark, root, dims=2)
    now = spark.createDataFrame([(9, "9", "f0.ts", "p", "f", "function", 1, 2, None, None, "silver ring")], maintenance.schemas.CHUNKS)
    fresh = spark.createDataFrame([(9, [0.0, 1.0])], maintenance.schemas.VECTORS), spark.createDataFrame([("f0.ts", "f1.ts"), ("f0.ts", "f2.ts")], maintenance.schemas.EDGES), files.where("file = 'f0.ts'")
    maintenance.save(spark, maintenance.updated(old, now, *fresh, spark.createDataFrame([("f1.ts",)], "file string")), root, dims=2)
    got = maintenance.load(spark, root, dims=2)
    anew = maintenance.build(chunks.where("ord = 2").unionByName(now), vectors.where("ord = 2").unionByName(fresh[0]), spark.createDataFrame([("f0.ts", "f2.ts")], maintenance.schemas.EDGES), files.where("file <> 'f1.ts'"))
    for name, df in anew.items():
        assert sorted(map(str, got[name].select(df.columns).collect())) == sorted(map(str, df.collect())), name


def test_a_version_is_seen_when_all_of_it_stands(spark, tmp_path):
    parts = _index(spark, ["red ring"])
    root = f"file://{tmp_path}/index"
    maintenance.save(spark, maintenance.build(*parts), root, dims=2)
    broken = maintenance.build(*parts) | {"files": parts[3].withColumn("n_lines", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        maintenance.save(spark, broken, root, dims=2)
    assert maintenance.load(spark, root, dims=2)["postings"].count() == 2


def test_static_model(spark):
    post = spark.createDataFrame([(1, "red"), (1, "ring"), (2, "red"), (3, "gone")], "ord long, term string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "ord long, embedding array<float>")
    terms = spark.createDataFrame([(7, "ring"), (7, "ring"), (8, "red"), (9, "gone"), (9, "what")], "item long, term string")
    got = {r["item"]: r["vector"] for r in static_model.embed(terms, "item", static_model.learn(post, vectors, 2, terms), 2).collect()}
    assert got == {7: pytest.approx([1, 0]), 8: pytest.approx([0.5**0.5] * 2)}
    assert embedding.is_static_model("minishlab/x") and embedding.is_static_model("org/Potion-base") and not embedding.is_static_model("org/bert-static")


@pytest.mark.parametrize(
    "text, ops",
    [
        ("noise\n  DELETE_FILE: a b.ts  \nmore noise", [("DELETE_FILE", "a b.ts")]),
        ("STRUCTURAL_EDIT: a.ts#fn_f\n\n action: set_body", [("ERROR", None)]),
        ("STRUCTURAL_EDIT: a.ts#fn_f\nACTION: Insert_Before\n\nCODE:\n\n  x();\n\nCREATE_FILE: b.ts\nCODE:\ny", [("INSERT_BEFORE", None), ("CREATE_FILE", "b.ts")]),
        ("STRUCTURAL_EDIT: a.ts#fn_f\nACTION: FLY\nCODE:\nx", [("ERROR", None)]),
        ("DELETE_FILE: a.ts\nCRITICAL_REFACTOR: RENAME x TO 1y", [("ERROR", None)]),
        ("MOVE_FILE: a.ts TO b.ts\nDELETE_FILE:", [("ERROR", None)]),
    ],
)
def test_op_forms(spark, text, ops):
    got = edits.parse_ops(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("op_index").collect()
    assert [(r["op_type"], r["path"]) for r in got] == ops and all((r["error"] is not None) == (r["op_type"] == "ERROR") for r in got)
    if ops[0][0] == "INSERT_BEFORE":
        assert got[0]["code"] == "  x();"


def test_queries_in_a_session_without_a_checkpoint_folder():
    code = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from lodestone.plans.queries import queries\n"
        "print('rows', queries()['graph_expand_1hop'](s, '/root/testdata/sf0.001').count())\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
