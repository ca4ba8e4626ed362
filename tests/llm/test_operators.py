"""Small cases of each operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import doc_text, neighbours, residue
from lodestone.llm.code_docs import documented_functions
from lodestone.llm.code_spans import spans_of
from lodestone.llm.fm_index import FMIndex, suffix_order
from lodestone.llm.foreign_files import content_kind, directory_hashes, foreign_files
from lodestone.llm.golay import decode, near_codes, syndrome
from lodestone.llm.leakage import find_leaks, words_of
from lodestone.llm.near_duplicates import components, near_duplicate_groups, near_duplicate_links, near_duplicate_pairs
from lodestone.llm.neighbours import buckets, hadamard, nearest
from lodestone.llm.packing import fill, pack, pack_group
from lodestone.llm.residue import detect_residue, residue_of
from lodestone.llm.splitting import spans, split_items

# Problem 1

CODE = '''
/** Opens the valve slowly so that pressure never spikes. */
export function openValve(a: string): void {
  // Says something inside the body of the function.
  const inner = () => 1;
}

/** Open valve. */
export const openOther = async (x: number): Promise<void> => {};

// Keeps rivers inside their banks during heavy rain.

export const apart = () => 1;

/**
 * Counts barrels before the ship leaves harbour.
 * @param n
 */
// eslint-disable-next-line
@Injectable()
export class Store<T extends Base> {
  private n = new Map();
  // Moves grain between silos overnight.
  static async move(a: string,
    b: string) {
    return `}${a ? `{${b}` : "}"}/* no */`;
  }
  /** Reads levels from every tank. */
  get level() { return 1; }
  /** Builds towers from wet sand. */
  constructor() {}
  /** Paints fences white every spring. */
  paint?(x: number): void;
}
/** Drinks tea whenever guests arrive unannounced. */
function over(a: string): void;
/** Never counted because it is second. */
function over(a: any) { return /[/{]\\/"/.test(a); }
const text = `
/** Not documentation since it is text. */
function hidden() {}
`;
/** Bakes bread for several villages. */
const notAFunction = call(() => 1);
/** Walks dogs around frozen lakes. */
export default function walk() {}
'''


def test_functions_and_their_comments(spark):
    rows = [("a.ts", CODE), ("a.ts", CODE.replace("\n", "\r\n")), ("b.md", CODE), ("c.js", None), ("d.js", ""), (None, CODE), ("e.tsx", "/** Long words appear here again. */\nfunction f() {}\n" + "x = 1;\n" * 50_000)]
    df = spark.createDataFrame(rows, "file string, content string").withColumn("name", F.lit(1)).withColumn("row", F.lit("x"))
    got = {(r["file"], r["name"]) for r in documented_functions(df).collect()}
    assert got == {("a.ts", n) for n in ("openValve", "Store.move", "Store.paint", "over", "walk")} | {("e.tsx", "f")}
    assert documented_functions(df.limit(0)).count() == 0


def test_declarations():
    code = "const a: (x: number) => void = (x) => {};\nconst b = (1 + 2);\nlet c = () => 1;\nconst d = function* () {};\nconst e =\n  async x => x;\nexport const g: Map<string, () => void> = new Map();\nclass K { m() {} }\nconst h = (a) as Fn;\n"
    assert [n for n, _, _ in spans_of(code)[1]] == ["a", "d", "e"]


@pytest.mark.parametrize(
    "name, comment, telling",
    [
        ("clearOwner", "/** Method to clear owner */", False),
        ("computeSeed", "// Compute the seed.", False),
        ("K.closeRanker", "/** Closes rankers of K. */", False),
        ("f", "// TODO: rewrite this whole thing before release", False),
        ("f", "// === public ===", False),
        ("f", "/* Helper. */", False),
        ("f", "/** Description goes here. */", False),
        ("f", "// const a = b.c(d);", False),
        ("f", "/**\n * @returns the number of open doors in the house\n */", False),
        ("f", "/**\n * @example\n * run(the, whole, thing);\n */", False),
        ("f", "// prettier-ignore", False),
        ("f", "/** */", False),
        ("pauseArchive", "// Não convém refazer o lote: o limite soma o menu fixo.", True),
        ("f", "/**\n * Our chapter drained the nested policy, although `x` had trimmed it\n * quickly.\n * @param a\n */", True),
        ("f", "// eslint-disable-next-line\n// Rotates both wheels at once.", True),
        ("f", "/** 按房间号返回所有未锁的门。 */", True),
        ("f", "/** 説明なし */", False),
        ("f", "/** 待补充 */", False),
        ("f", "/** 函数 */", False),
    ],
)
def test_says_something(name, comment, telling):
    assert doc_text.says_something(name, comment) is telling


# Problem 2


@pytest.mark.parametrize(
    "text, kind",
    [
        ("// Code generated by tool. DO NOT EDIT.\nexport const a = 1;\n", "generated"),
        ('"use strict";\nimport { a } from "b";\n// @generated by tool 1.2\nconst a = 1;', "generated"),
        ("/**\n * @license lib 1.2.3\n */\nfunction f() {}", "vendored"),
        ("// Hand-written on purpose: the generated client was too slow.\nfunction f() {}", None),
        ("// Do not edit the order of the two calls below.\nf();\ng();", None),
        ("const hints = ['Code generated by tool. DO NOT EDIT.'];\nfunction f() {}", None),
        ("function f() {}\n//# sourceMappingURL=f.js.map", "built"),
        ("var a=(()=>{" + "b.c(d);" * 80 + "})();", "built"),
        ("export const t = [" + "0x1f,0x2e," * 60 + "];", "data"),
        ("export const t = [\n" + ("0x1f,0x2e,0x3d,0x4c," * 5 + "\n") * 20 + "];", "data"),
        ('export const hints = ["' + "words with many spaces " * 20 + '"];', None),
        ("", None),
        (None, None),
    ],
)
def test_content_kind(text, kind):
    assert content_kind(text) == kind


def test_headers_behind_long_imports():
    assert content_kind("import {\n" + "  name,\n" * 600 + '} from "x";\n// @generated by tool 1.2\nconst a = 1;\n') == "generated"


def test_foreign_files(spark):
    body = "export function f() {\n  return 1;\n}\n" * 40
    rows = [
        ("apps/a/node_modules/x/i.js", "p", "f();"), ("apps/a/src/generators/g.ts", "p", body), ("apps/a/src/x.min.js", "p", body), ("apps/a/dist/README.md", "p", "# x"),
        ("apps/a/src/lib/one.ts", "p", body), ("apps/a/src/lib/two.ts", "p", body + "//2"), ("apps/b/src/lib/copy/one.ts", "q", body), ("apps/b/src/lib/copy/two.ts", "q", body + "//2"),
        ("apps/b/src/own.ts", " q ", body + "//3"), ("forked/x/y.ts", None, "f();"), ("apps/b/src/z.ts", "fork", "f();"), (None, None, None), ("apps/b/src/n.ts", None, None), ("apps/b/src/n.ts", None, None),
    ]
    files = spark.createDataFrame(rows, "file string, pkg string, content string").withColumn("kind", F.lit(1)).withColumn("dir", F.lit("d"))
    packages = spark.createDataFrame([("@s/a", "apps/a", "backend"), ("@s/b", "apps/b", None), ("@s/c", "c", None), ("fork", "forked/x", None), ("docs", "docs", " Docs ")], "name string, dir string, role string")
    got = {r["file"]: r["why"] for r in foreign_files(files, packages).collect()}
    assert got == {
        "apps/a/node_modules/x/i.js": "path", "apps/a/src/x.min.js": "path", 
        "apps/b/src/lib/copy/one.ts": "subtree", "apps/b/src/lib/copy/two.ts": "subtree", "forked/x/y.ts": "package", "apps/b/src/z.ts": "package",
    }
    assert foreign_files(files.limit(0), packages).count() == 0


def test_directory_hashes_do_not_depend_on_order_or_place(spark):
    rows = [("a/x/1.ts", "one"), ("a/x/d/2.ts", "two"), ("b/y/x/1.ts", "one"), ("b/y/x/d/2.ts", "two"), ("c/x/1.ts", "one"), ("c/x/d/3.ts", "two")]
    for order in (rows, rows[::-1]):
        h = {r["dir"]: (r["h1"], r["h2"]) for r in directory_hashes(spark.createDataFrame(order, "file string, content string"), "file", "content").collect()}
        assert h["a/x"] == h["b/y/x"] != h["c/x"]


# Problem 3


def _brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    return {(int(a), int(ids[j])) for a, row in zip(ids, s) for j in np.lexsort((ids, -row))[:k]}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.normal(size=(50, 64)), 12, axis=0) + 0.7 * rng.normal(size=(600, 64))).astype(np.float32)
    x[300:400] = x[7]  # copies: a sixth of all rows
    ids = rng.permutation(600) + 1
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [1.0] * 32), (9004, [float("nan")] * 64), (None, [1.0] * 64), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, "ord long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("e", F.lit(1))
    got = nearest(df, "ord", "embedding", 10).collect()
    pairs = {(r["ord"], r["neighbour"]) for r in got}
    want = _brute(ids, x.astype(np.float64), 10)
    assert len(pairs) == len(got) and {r["ord"] for r in got} <= set(map(int, ids))
    assert len(pairs & want) / len(want) >= 0.9
    twins = {(a, b) for a, b in want if a in set(map(int, ids[300:400])) }
    assert twins <= pairs  # copies are found exactly, ties by the smaller id
    some = nearest(df, "ord", "embedding", 10, queries=F.col("_id") % 50 == 0).collect()
    assert {r["ord"] for r in some} == {int(i) for i in ids if i % 50 == 0}
    assert nearest(df.limit(0), "ord", "embedding").count() == 0


def _recall(spark, x, **how):
    ids = np.arange(len(x)) + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "ord long, embedding array<float>")
    got = [(r["ord"], r["neighbour"]) for r in nearest(df, "ord", "embedding", 10, queries=F.col("_id") % 50 == 0, **how).collect()]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for i in ids[ids % 50 == 0]:
        sims = np.round(u @ u[i - 1], 6)
        sims[i - 1] = -9
        want |= {(int(i), int(ids[j])) for j in np.lexsort((ids, -sims))[:10]}
    assert len(got) == len(set(got))
    return len(want & set(got)) / len(want)


@pytest.mark.parametrize("rows", [6000, 15000])
def test_recall_of_hashed_buckets(spark, rows):
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(rows // 15, 64)), 15, axis=0) + 1.0 * rng.normal(size=(rows, 64))).astype(np.float32)
    assert rows // (2 * neighbours.AXES) > neighbours.LEAST  # no bucket is compared whole
    assert _recall(spark, x) >= 0.9
    assert _recall(spark, x, fine_probes=1) < _recall(spark, x)


def test_share_of_pairs_compared():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = buckets(x, 0, neighbours.TABLES, neighbours.AXES, neighbours.PROBES)
    met = 0
    for t in range(neighbours.TABLES):
        for b in range(2 * neighbours.AXES):
            rows, asked = x[own[:, t, 0] == b], x[(own[:, t] == b).any(axis=1)]
            for f in range(neighbours.FINE):
                number = neighbours.TABLES + t * neighbours.FINE + f
                cells = np.bincount(buckets(rows, number, 1, 64, 1).ravel(), minlength=128)
                met += cells[buckets(asked, number, 1, 64, neighbours.FINE_PROBES)].sum()
    assert met / len(x) ** 2 < 0.25  # on vectors without clusters


def test_blocks_of_rows_and_queries_find_the_same(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(600, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>")
    monkeypatch.setattr(neighbours, "BLOCK", 150)  # two buckets of 300 rows, each asked by 600
    got = {(r["ord"], r["neighbour"]) for r in nearest(df, "ord", "embedding", 10, tables=2, axes=1, fine=0).collect()}
    assert got == _brute(np.arange(600), x.astype(np.float64), 10)


def test_many_blocks_move_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    x = np.random.default_rng(8).normal(size=(900, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>")
    sc = spark.sparkContext
    written = lambda: sum(s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)))
    before = written()
    got = {(r["ord"], r["neighbour"]) for r in nearest(df, "ord", "embedding", 10, tables=2, axes=1, fine=0).collect()}
    assert got == _brute(np.arange(900), x.astype(np.float64), 10)
    assert written() - before < x.nbytes


def test_a_copy_is_asked_for_without_the_first_row_of_its_class(spark):
    x = np.random.default_rng(9).normal(size=(120, 64)).astype(np.float32)
    x[50] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<float>")
    got = {(r["ord"], r["neighbour"]) for r in nearest(df, "ord", "embedding", 10, fine=0, queries=F.col("_id") == 50).collect()}
    assert len(got) == 10 and (50, 7) in got


def test_ties_beyond_float_precision_go_to_the_smaller_id(monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=64) * rng.uniform(0.1, 9, size=(40, 1))).astype(np.float32)  # one direction at 40 lengths
    x = np.vstack([x, rng.normal(size=(200, 64)).astype(np.float32)])
    ids, unit = rng.permutation(len(x)) + 1, x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for pairs in (neighbours.PAIRS, 100):
        monkeypatch.setattr(neighbours, "PAIRS", pairs)
        monkeypatch.setattr(neighbours, "CELLS", 30 * pairs)
        asked, near, _ = neighbours.nearest_in_block(ids, unit, ids, unit, 10)
        assert set(zip(asked.tolist(), near.tolist())) == _brute(ids, x.astype(np.float64), 10)


def test_rotation_keeps_lengths_and_probes_start_with_the_own_bucket():
    x = np.random.default_rng(0).normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    one, two = buckets(x, 0, 3, 32, 1), buckets(x, 0, 3, 32, 2)
    assert (one[:, :, 0] == two[:, :, 0]).all() and (two[:, :, 0] != two[:, :, 1]).all() and two.max() < 64
    every = buckets(x, 0, 3, 4, 8)
    assert (np.sort(every, axis=2) == np.arange(8)).all() and (every[:, :, :1] == buckets(x, 0, 3, 4, 1)).all()


# Problem 4


@pytest.mark.parametrize("text", ["", "short", "x" * 5000, "word " * 1000, "line\n" * 900, "\n" * 4000, "Ein Satz. " * 400 + "\n\n" + "Other words here. " * 300, "é😀" * 2000])
def test_spans(text):
    s = spans(text, 1500, 150)
    assert s[0][0] == 0 and s[-1][1] == len(text) and all(0 <= b - a <= 1500 for a, b in s)
    assert all(y[0] == x[1] - 150 and y[1] > x[1] for x, y in zip(s, s[1:]))


def test_cut_at_the_change_of_topic():
    a, b = "Ships sail over deep water with cargo.\n" * 24, "Bread needs flour yeast and salt today.\n" * 24
    assert spans(a + b, 1500, 100)[0][1] == len(a)


def test_split_items(spark):
    rows = [(1, "kind f\n" + "a = 1;\n" * 400, 410, 11), (1, "x", 1, 1), (2, None, 1, 2), (3, "", None, 5), (4, "x" * 1500, 1, 1), (5, "x" * 1501, 3, 3)]
    df = spark.createDataFrame(rows, "ord long, text string, start_line int, end_line int").withColumn("piece", F.lit(9)).withColumn("s", F.lit(9))
    got = split_items(df, "ord", "text", "start_line", "end_line").collect()
    assert {r["ord"]: r["pieces"] for r in got if r["ord"] != 1} == {3: 1, 4: 1, 5: 2}
    own = sorted((r for r in got if r["ord"] == 1 and r["pieces"] > 1), key=lambda r: r["piece"])
    assert (own[0]["start_line"], own[-1]["end_line"]) == (11, 410)
    assert split_items(df.limit(0), "ord", "text").count() == 0
    with pytest.raises(ValueError):
        split_items(df, "ord", "text", limit=10, overlap=10)


# Problem 5


def test_golay():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 2000)
    codes = near_codes(w)
    assert (codes[:, 0] == decode(w)).all() and max(len(set(r)) for r in codes.tolist()) <= 6
    for _ in range(300):
        a = int(rng.integers(1 << 23))
        i, j = rng.choice(23, 2, replace=False)
        near = near_codes(np.array([a, a ^ (1 << int(i)) ^ (1 << int(j))]))
        assert set(near[0]) & set(near[1])
    assert (syndrome(w) ^ syndrome(w[::-1]) == syndrome(w ^ w[::-1])).all()


def _jaccard(a, b, size):
    import re

    runs = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (re.findall("[a-z0-9]+", t.lower()) for t in (a, b))]
    return len(runs[0] & runs[1]) / len(runs[0] | runs[1]) if runs[0] | runs[1] else 0


@pytest.mark.parametrize("size, threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates(spark, size, threshold):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.randint(6, 120))
        texts.append(" ".join(base))
        for _ in range(2):
            edited = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 14))):
                edited[rnd.randrange(len(edited))] = "edit"
            texts.append(", ".join(edited).upper())
    texts += ["one two", "one two", "one", "", None, texts[0], texts[0], "Stock phrase of the house; " * 3 + "own words follow " + " ".join(vocabulary[:40])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("a", F.lit(0)).withColumn("code", F.lit(0))
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in near_duplicate_pairs(df, "id", "text", size, threshold).collect()}
    want = {(i, j): s for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and (s := _jaccard(texts[i], texts[j], size)) >= threshold}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert near_duplicate_pairs(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("block", [8192, 50])
def test_near_duplicates_that_share_one_stock_phrase_alone(spark, monkeypatch, block):
    from lodestone.llm import near_duplicates

    monkeypatch.setattr(near_duplicates, "HOT_BLOCK", block, raising=False)
    rnd = random.Random(8)
    vocabulary, stock = [f"w{i}" for i in range(5000)], [f"stock{i}" for i in range(16)]
    texts = []
    for _ in range(300):
        base = rnd.choices(vocabulary, k=26)
        for edits in (rnd.sample(range(26), 3), ()):
            texts.append(" ".join([*stock, *("edit" + str(rnd.random())[2:] if i in edits else w for i, w in enumerate(base))]))
    prints = near_duplicates.fingerprints(texts, 3)
    count = Counter(a for p in prints for a in set(p[1]))
    codes = near_duplicates.near_codes
    want = set()  # pairs that meet in one anchor alone, which is hot, with a code in common
    for i in range(0, len(texts), 2):
        one, two = (dict(zip(prints[j][1], prints[j][2])) for j in (i, i + 1))
        met = [a for a in one if a in two]
        if _jaccard(texts[i], texts[i + 1], 3) >= 0.5 and len(met) == 1 and count[met[0]] > near_duplicates.HOT:
            if set(codes(np.array([one[met[0]]]))[0]) & set(codes(np.array([two[met[0]]]))[0]):
                want.add((i, i + 1))
    copies = [(1000 + i, texts[0]) for i in range(70)]
    df = spark.createDataFrame(list(enumerate(texts)) + copies, "id long, text string")
    got = [(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(df, "id", "text", 3, 0.5).collect()]
    assert want and want <= set(got) and len(got) == len(set(got))
    every = {(i, i + 1) for i in range(0, len(texts), 2) if _jaccard(texts[i], texts[i + 1], 3) >= 0.5}
    assert len(every & set(got)) >= 0.97 * len(every)
    assert {(1, i) for i, _ in copies} <= set(got) or (0, 1) not in set(got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (200, 201)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_links(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join([*w[:30], "x", *w[31:]]), " ".join([*w[:30], "x", *w[31:58], "y", w[59]])
    rows = [(5, a), (1, a), (2, b), (3, c), (4, "quite another text with its own words here"), (6, None), (7, "same few words in this one"), (8, "same few words in this one")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["group"], r["links"]) for r in near_duplicate_groups(df, "id", "text").collect()}
    assert got == {1: (1, 2), 5: (1, 2), 2: (1, 3), 3: (1, 1), 7: (7, 1), 8: (7, 1)}
    assert {(r["id_a"], r["id_b"]) for r in near_duplicate_links(df, "id", "text").collect()} == {(1, 2), (2, 3)}


# Problem 6


def test_pack_group():
    sizes = np.array([500, 300, 212, 200, 12, 0, 512])
    place = pack_group(sizes, 512)
    load = np.bincount(place, weights=sizes)
    assert load.max() <= 512 and len(set(place[[0, 1, 6]])) == 3
    assert len(pack_group(np.array([], dtype=int), 512)) == 0


def test_pack(spark):
    rows = [(1, "word " * 1300), (1, "word"), (2, None), (3, ""), (4, "the of a"), (None, "word word")] + [(10 + i, "word " * (i % 90)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("x")).withColumn("piece", F.lit(0))
    got = pack(df, "doc_id", "text", 512).collect()
    load = {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert max(load.values()) <= 512 and sum(load.values()) == sum(len((t or "").replace("the of a", "").split()) for _, t in rows)
    assert sorted(r["tokens"] for r in got if r["pieces"] == 3) == [276, 512, 512]
    assert len(got) == len(rows) + 2
    assert pack(df.limit(0), "doc_id", "text").count() == 0
    assert fill(pack(df, "doc_id", "text", 512)).first()["filled"] > 0.95


# Problem 7


def test_fm_index():
    rng = np.random.default_rng(0)
    for sigma in (3, 40, 70_000):
        t = rng.integers(1, sigma, 800)
        t[::50] = 0
        t[100:200] = t[400:500]
        whole = np.append(t, 0).tolist()
        assert suffix_order(np.array(whole), sigma).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        index = FMIndex(t, sigma)
        phrases = np.array([t[i : i + 4] for i in rng.integers(0, 796, 60)])
        low, high = index.search(phrases[(phrases > 0).all(axis=1)])
        for p, a, b in zip(phrases[(phrases > 0).all(axis=1)], low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(t) - 3) if (t[i : i + 4] == p).all()]


def test_places_behind_separators():
    rng = np.random.default_rng(1)
    for _ in range(30):
        texts = [rng.integers(2, 12, rng.integers(1, 12)) for _ in range(20)]
        t = np.concatenate([np.append(x, 0) for x in texts])
        index = FMIndex(t, 12)
        low, high = index.search(np.arange(2, 12)[:, None])
        for w, a, b in zip(range(2, 12), low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == np.flatnonzero(t == w).tolist()


def test_words_of():
    assert words_of("**Bold** &amp; ﬁne can­not <b>go</b> É_x") == ["bold", "fine", "cannot", "go", "e", "x"]


def test_leaks(spark):
    rnd = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    task = {i: rnd.sample(words, 60) for i in range(4)}
    formula = "Please do the following thing with all of the many files that are there now"
    items = [(i, f"{formula}: " + " ".join(w)) for i, w in task.items()] + [(8, None), (9, "")]
    noise = lambda n: [rnd.choice(words) for _ in range(n)]
    edited = list(task[1][10:40])
    edited[8], edited[20] = "other", "other"
    rare = list(task[1][:40])
    for k in range(2, 40, 5):
        rare[k] = "other"
    docs = [
        (1, " ".join(noise(30) + task[0][5:25] + noise(30))), (2, "> " + ",\n> ".join(noise(30) + edited + noise(9)).upper()), (3, " ".join(noise(20) + task[0][5:24] + noise(20))),
        (4, " ".join(rare)), (5, " ".join(rnd.sample(task[2], 60))), (6, formula + " " + " ".join(noise(30))), (7, None), (8, ""), (9, " ".join(noise(5000) + task[3] + noise(5000))), (9, " ".join(task[3][:20])),
        (10, " ".join(task[2][0:12] + ["extra"] + task[2][12:18] + task[2][19:30])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    it = spark.createDataFrame(items, "item_id long, task string")
    got = find_leaks(df, "doc_id", "text", it, "item_id", "task").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (9, 3), (10, 2)}
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["words"], one["edits"], one["start_word"], one["end_word"]) == (20, 0, 30, 50)
    assert find_leaks(df.limit(0), "doc_id", "text", it, "item_id", "task").count() == 0
    assert find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "task").count() == 0


def _leak(spark, item, text):
    d, i = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, task string")
    return sorted((r["start_word"], r["end_word"], r["words"], r["edits"]) for r in find_leaks(d, "doc_id", "text", i, "item_id", "task").collect())


def test_leaks_around_markup_of_any_length(spark):
    words = [f"w{i}" for i in range(24)]
    for tag in ('<a href="http://x.y/' + "z" * 200 + '" target="_blank">', "<b>"):
        assert _leak(spark, " ".join(words), " ".join([*words[:12], tag, *words[12:]])) == [(0, 24, 24, 0)]
    link = " ".join([*words[:11], f"[{words[11]}](http://x.y/" + "q/" * 60 + ")", *words[12:]])
    assert _leak(spark, " ".join(words), link) == [(0, 24, 24, 0)]


def test_a_long_gap_in_a_long_passage(spark):
    words = [f"w{i}" for i in range(300)]
    assert _leak(spark, " ".join(words), " ".join(words[:140] + words[170:])) == [(0, 270, 300, 30)]


def test_all_passages_and_their_spans(spark):
    from lodestone.llm.leakage import removal_spans

    a, b, noise = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(30)], [f"n{i}" for i in range(50)]
    text = [*noise[:5], *a[:25], *noise[:20], *a[10:], *b, *noise]
    d = spark.createDataFrame([(1, " ".join(text)), (1, " ".join(text)), (2, " ".join(a))], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[30:], *b[:15]]))], "item_id long, task string")
    leaks = find_leaks(d.limit(3), "doc_id", "text", i, "item_id", "task")
    assert sorted({(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in leaks.collect()}) == [(1, 1, 5, 30), (1, 1, 50, 80), (1, 2, 80, 110), (1, 3, 70, 95), (2, 1, 0, 40)]
    assert sorted(map(tuple, removal_spans(leaks, "doc_id").collect())) == [(1, 5, 30, 25), (1, 50, 110, 60), (2, 0, 40, 40)]
    assert removal_spans(leaks.limit(0), "doc_id").count() == 0


def test_items_in_several_blocks_find_the_same(spark, monkeypatch):
    from lodestone.llm import leakage

    items = [(i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(20)]
    d = spark.createDataFrame([(i, "before " + t + " behind") for i, t in items], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, task string")
    want = sorted(map(tuple, find_leaks(d, "doc_id", "text", it, "item_id", "task").collect()))
    monkeypatch.setattr(leakage, "ITEM_CHARS", 1000)
    assert len(want) == 20 and sorted(map(tuple, find_leaks(d, "doc_id", "text", it, "item_id", "task").collect())) == want


# Problem 8


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Real words about ships.\n\nComing soon.", "empty"),
        ("502 Bad Gateway", "error"),
        ("<html><head><title>503 Service Unavailable</title></head></html>", "error"),
        ("Bitte JavaScript aktivieren, um den Inhalt anzuzeigen.", "script"),
        ("Hello {{ name }}, welcome.", "slot"),
        ("Version NaN of undefined.", "slot"),
        ("Dolor sit amet fugiat mollit turpis.", "filler"),
        ("Sign in again to continue.", "login"),
        ("Checking your browser...", "wait"),
        ("Error pages such as 502 Bad Gateway are kept apart from the final payout by its toolbar.", None),
        ("We renamed the 'Coming soon' cache because the catalog took it for clean content.", None),
        ("Templates use `{{ widget }}` slots.", None),
        ("```html\n<h1>{{ title }}</h1>\nLoading...\n```\nThe page above is drawn by hand.", None),
        ("export const page = \"We are down for maintenance\";\nrender(`${report.title}`);\nfunction f() {\n  return 1;\n}\n", None),
        ("", None),
        ("  \n ", None),
        (None, None),
    ],
)
def test_residue(text, kind):
    found = residue_of(text)
    assert (found and found[0]) == kind


@pytest.mark.parametrize(
    "text, found",
    [
        ("export const f = (x: number): { a: string; b: number } => {\n  return g(x);\n};", True),
        ("const f = (\n" + "  x: number,\n" * 90 + ") => x;", True),
        ("const f: {\n" + "  (x: number): void;\n" * 90 + "} = (x) => x;", True),
        ("const f = (x: number): {\n" + "  a: string;\n" * 90 + "} => g(x);", True),
        ("export const f = (\n" + "".join(f"  parameter{i}: string,\n" for i in range(70)) + "): number => 1;", True),
        ("const f = (x: number): " + " | ".join(f"Type{i}" for i in range(100)) + " => x;", True),
        ("const f = (a + b);\nconst g = 1;\nlist.map((x) => x);", False),
        ("declare const f: Foo\nconst g = 1\nlet h = (x) => x", False),
    ],
)
def test_constants_with_long_types_and_parameters(text, found):
    assert ("f" in [n for n, _, _ in spans_of(text)[1]]) == found


@pytest.mark.parametrize(
    "text, kind",
    [
        ("* Add the reader\n* Drop the writer\n* Lorem ipsum dolor sit amet, consectetur adipiscing elit\n* Rename a field", "filler"),
        ("foo bar baz test foo bar", "filler"),
        ("The page  was  not  found.", "error"),
        ("const a = 1;\nconst b = 2;\nexport function f() {\n  return a + b;\n}\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
        ("/*\n * Lorem ipsum dolor sit amet, consectetur\n * please wait\n */\nconst a = 1;\nexport default a;", None),
        ("* Add the reader\n* Drop the writer\n* Rename a field", None),
    ],
)
def test_residue_among_bullets_and_code(text, kind):
    assert (r := residue_of(text)) is None and kind is None or r is not None and r[0] == kind


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Dear {{ " + "customer.address." * 12 + "name }}, welcome.", "slot"),
        ("Read [insert the name of the person who is responsible for the delivery and all that comes behind it here].", "slot"),
        ("<p class='" + "x" * 300 + "'>502 Bad Gateway</p>", "error"),
    ],
)
def test_residue_in_long_slots_and_tags(text, kind):
    assert residue_of(text)[0] == kind


def test_share_is_of_the_text(spark):
    from lodestone.llm.residue import excluded

    assert residue_of("Access denied.")[1] == 1.0
    long = "Ships sail over deep water with their cargo. " * 50 + "Access denied."
    assert 0 < residue_of(long)[1] < 0.02
    df = spark.createDataFrame([(1, "Access denied."), (2, long), (3, None), (4, "Ships sail.")], "doc_id long, text string")
    assert [r["doc_id"] for r in excluded(df, "doc_id", "text").collect()] == [1]
    assert sorted(r["doc_id"] for r in detect_residue(df, "doc_id", "text").collect()) == [1, 2]


def test_detect_residue(spark):
    rows = [(1, "Coming soon."), (1, "Coming soon."), (2, None), (3, ""), (4, "Ships sail. " * 40_000 + "Access denied."), (None, "Loading...")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1))
    got = sorted(((r["doc_id"] or 0), r["kind"]) for r in detect_residue(df, "doc_id", "text").collect())
    assert got == [(0, "wait"), (1, "empty"), (1, "empty"), (4, "error")]
    assert detect_residue(df.limit(0), "doc_id", "text").count() == 0
    assert residue.COVERAGE == 0.5
