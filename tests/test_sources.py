import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import embedding
from lodestone.sources import workspace as ws


def test_config_and_packages(tmp_path):
    assert ws.read_config(str(tmp_path)).top_n == 8
    (tmp_path / "lodestone.config.json").write_text("{broken")
    (tmp_path / ".lodestone.json").write_text(json.dumps({"top_n": 3, "docs": ["*.md"], "other": 1}))
    c = ws.read_config(str(tmp_path))
    assert (c.top_n, c.docs, c.hops) == (3, ("*.md",), 2)
    assert ws.packages(str(tmp_path)) == [("root", ".")]
    (tmp_path / "package.json").write_text(json.dumps({"name": "top", "workspaces": {"packages": ["apps/*"]}}))
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'libs/*' # own\n  - apps/*\nother:\n  - x/*\n")
    assert ws.workspace_globs(str(tmp_path)) == ["apps/*", "libs/*"]
    assert ws.packages(str(tmp_path)) == [("top", ".")]
    (tmp_path / "apps/a").mkdir(parents=True)
    (tmp_path / "apps/a/package.json").write_text(json.dumps({"name": "@s/a"}))
    assert ws.packages(str(tmp_path)) == [("@s/a", "apps/a")]
    assert ws.typescript_config(str(tmp_path), "apps/a") == "tsconfig.json"
    (tmp_path / "apps/a/tsconfig.app.json").write_text(json.dumps({"compilerOptions": {"lib": ["DOM", "ES2022"], "types": ["node"]}}))
    (tmp_path / "apps/a/package.json").write_text(json.dumps({"name": "@s/a", "dependencies": {"Express": "1"}, "devDependencies": {"vite": "2"}}))
    assert ws.typescript_config(str(tmp_path), "apps/a") == "apps/a/tsconfig.app.json"
    deps, options = ws.role_signals(str(tmp_path))
    assert sorted(deps) == [("@s/a", "express"), ("@s/a", "vite")] and sorted(options) == [("@s/a", "lib", "dom"), ("@s/a", "lib", "es2022"), ("@s/a", "types", "node")]
    assert ws.ignore_rules(str(tmp_path)) == []
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    assert ws.ignore_rules(str(tmp_path)) == ["*.log", "!keep.log"]
    (tmp_path / "pnpm-workspace.yaml").write_text('packages: ["one/*", two]\n')
    assert ws.workspace_globs(str(tmp_path)) == ["apps/*", "one/*", "two"]


@pytest.mark.parametrize("path, out", [("a/node_modules/x.ts", True), ("a/x.log", True), ("keep.log", False), ("build/x", True), ("a/build/x", False), ("src/a.ts", False), ("../a.ts", True), ("", True)])
def test_ignored(spark, path, out):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(ws.ignored(F.col("p"), ["*.log", "!keep.log", "/build/", "# note", ""]).alias("x")).first()["x"] is out


def test_scan(spark, tmp_path):
    for name, text in {"src/a.ts": "x\ny\n", "src/a.d.ts": "z", "README.md": "# hi", "node_modules/b.ts": "b", "c.py": "c"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["file"]: (r["content"], r["n_lines"], r["is_doc"]) for r in ws.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": ("x\ny\n", 3, False), "README.md": ("# hi", 1, True)}


def test_static_embed(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"red": 0, "[UNK]": 1, "ring": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    rows = np.array([[3, 0], [9, 9], [0, 4]], dtype=np.float32)
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [3, 2], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m").write_bytes(struct.pack("<Q", len(header)) + header + rows.tobytes())
    f = embedding.static_embed(str(tmp_path / "m"), str(tmp_path / "t.json"))
    got = [list(r["v"]) for r in spark.createDataFrame([("red ring",), ("red what",), ("what",), (None,)], "t string").select(f("t").alias("v")).collect()]
    assert got == [pytest.approx([0.6, 0.8]), pytest.approx([1, 0]), [0, 0], [0, 0]]
    (tmp_path / "bad").write_bytes(struct.pack("<Q", len(header)) + header.replace(b"F32", b"F16") + rows.tobytes())
    with pytest.raises(ValueError):
        embedding.read_safetensors(str(tmp_path / "bad"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_cli(spark, capsys):
    cli.main(["retrieve", "/root/testdata/sf0.001", "--task", "flatten the minor swatch of the header", "--top", "3", "--json"])
    entries = json.loads(capsys.readouterr().out)
    assert [e["pos"] for e in entries] == list(range(1, len(entries) + 1)) and len(entries) >= 3


def test_cli_index_and_update(spark, tmp_path, capsys):
    files = {
        "package.json": json.dumps({"name": "top", "workspaces": ["apps/*"]}), "apps/a/package.json": json.dumps({"name": "@s/a"}),
        "apps/a/src/ring.ts": 'import { bolt } from "./bolt";\n/** Turns the copper ring. */\nexport function turnRing() {\n  return bolt;\n}\n',
        "apps/a/src/bolt.ts": "export const bolt = 1;\nexport class Gear {\n  spin() {}\n}\n", "README.md": "# Rings\n\nCopper rings turn.\n",
    }
    root, where = tmp_path / "ws", f"file://{tmp_path}/index"
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    cli.main(["index", str(root), where])
    from lodestone.operators import maintenance

    i = maintenance.load(spark, where)
    assert {(r["symbol"], r["kind"], r["pkg"]) for r in i["chunks"].collect()} == {("turnRing", "function", "@s/a"), ("bolt", "const", "@s/a"), ("Gear", "class", "@s/a"), ("Gear.spin", "method", "@s/a"), ("README.md:Rings", "doc", "docs")}
    assert {tuple(r) for r in i["edges"].collect()} == {("apps/a/src/ring.ts", "apps/a/src/bolt.ts")}
    (root / "apps/a/src/ring.ts").write_text("export function silverRing() {}\n")
    (root / "README.md").unlink()
    cli.main(["update", str(root), where, "apps/a/src/ring.ts", "README.md", "other.png"])
    i = maintenance.load(spark, where)
    assert {r["symbol"] for r in i["chunks"].collect()} == {"silverRing", "bolt", "Gear", "Gear.spin"}
    assert i["edges"].count() == 0 and {r["file"] for r in i["files"].collect()} == {"apps/a/src/ring.ts", "apps/a/src/bolt.ts"}
    anew = maintenance.build(i["chunks"], i["vectors"], i["edges"], i["files"])
    for name, columns in {"postings": ("ord", "term", "tf"), "df": ("term", "n"), "doclen": ("ord", "file", "len"), "stats": ("n_docs", "avgdl")}.items():
        assert sorted(map(tuple, i[name].select(*columns).collect())) == sorted(map(tuple, anew[name].select(*columns).collect()))
    capsys.readouterr()
    cli.main(["retrieve", where, "--task", "silver ring", "--json"])
    entries = json.loads(capsys.readouterr().out)
    assert entries[0]["file"] == "apps/a/src/ring.ts" and entries[0]["pkg"] == "@s/a"
    # The configuration of the workspace: words of a layer, roles and weights of packages.
    (root / "lodestone.config.json").write_text(json.dumps({"package_roles": {"@s/a": "mobile", "other": "nothing"}, "layer_terms": {"mobile": ["silver"]}, "package_weights": {"@s/a": 2.0}, "top_n": 1, "boost": 1.0}))
    cli.main(["retrieve", where, "--task", "silver ring", "--json", "--root", str(root)])
    weighted = json.loads(capsys.readouterr().out)
    assert len(weighted) == 1 and weighted[0]["score"] == pytest.approx(4 * entries[0]["score"])
