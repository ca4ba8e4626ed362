"""The registered queries of the engine: name -> callable(spark, sf_dir). `sql` has the SQL of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import paths, vector
from lodestone.functions.text import explode_tokens, token_count, tokenize
from lodestone.operators import batch, edits, evaluation, fusion, graph, indexing, maintenance, search, static_model, structure
from lodestone.operators import manifest as man
from lodestone.sources import views as V
from lodestone.streaming import ingest
from lodestone.tables import cut, ensure_checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

GLOBS = ["apps/*/src/**/*.ts", "packages/**/*.service.ts", "libs/**/?i*.tsx"]
EXCLUDED = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/*.test.ts"]
HOT_PKG = "@quillon/ledger-api"


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _long(name: str):
    return F.col(name).cast("long").alias(name)


def _sources(s: SparkSession, d: str) -> DataFrame:
    """(file, content): each source file once."""
    return table(s, d, "source_files").groupBy("file").agg(F.max("content").alias("content"))


# Text and lexical search


@query
def tokenize_chunks(s, d):
    t = V.chunks_now(s, d).select("ord", tokenize(F.col("text")).alias("t"))
    return t.select("ord", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query
def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", token_count(F.col("text")).alias("n"))


@query
def term_freq(s, d):
    return search.postings(V.chunks_now(s, d))


@query
def doc_freq(s, d):
    return search.doc_freq(search.postings(V.chunks_now(s, d)))


@query
def corpus_stats(s, d):
    return search.corpus_stats(V.chunks_now(s, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def _terms(s, d):
    return search.query_terms(V.task(s, d), "task")


@query
def bm25_topk(s, d):
    return search.top(search.bm25(V.chunks_now(s, d), _terms(s, d)))


@query
def bm25_files(s, d):
    return search.ranked_files(bm25_topk(s, d))


@query
def bm25_documents(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("ord"), F.coalesce("source", F.lit("")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return search.top(search.bm25(docs, _terms(s, d)))


@query
def symbol_search(s, d):
    return search.symbol_files(search.symbol_scores(V.symbols_now(s, d), V.task(s, d)))


# Dense search


def _query_vector(s, d):
    return V.vectors_now(s, d).orderBy("ord").limit(1).select(F.col("embedding").alias("q"))


@query
def dense_topk(s, d):
    return search.top(search.dense(table(s, d, "chunks"), V.vectors_now(s, d), _query_vector(s, d)))


@query
def dense_files(s, d):
    return search.ranked_files(dense_topk(s, d))


@query
def cosine(s, d):
    v = V.vectors_now(s, d).crossJoin(F.broadcast(_query_vector(s, d)))
    return v.select("ord", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query
def max_abs_diff(s, d):
    v = V.vectors_now(s, d).crossJoin(F.broadcast(_query_vector(s, d)))
    return v.select("ord", F.round(vector.max_abs_diff(F.col("embedding"), F.col("q")), 6).alias("diff"))


@query
def l2_normalize(s, d):
    n = V.vectors_now(s, d).select("ord", vector.l2_normalize(F.col("embedding")).alias("v"))
    return n.select("ord", F.round(vector.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query
def static_embed(s, d):
    """Vectors of the tasks, made of their tokens by a static model learned from the chunks."""
    terms = search.query_terms(table(s, d, "eval_items").where("task is not null"), "task", "item_id")
    post = V.chunks_now(s, d).select("ord", explode_tokens(F.col("text")).alias("term"))
    v = static_model.embed(terms, "item_id", static_model.learn(post, V.vectors_now(s, d), V.DIMS, terms), V.DIMS)
    return v.select("item_id", F.round(vector.norm(F.col("vector")), 5).alias("norm"), F.round(F.element_at("vector", 1), 5).alias("first"), F.round(F.element_at("vector", -1), 5).alias("last"))


# Fusion and weights


def _fused(s, d):
    return fusion.rrf([dense_files(s, d), bm25_files(s, d), symbol_search(s, d).select("file", "rank")])


@query
def rrf_fusion(s, d):
    return _fused(s, d)


@query
def layer_hits(s, d):
    return fusion.layer_hits(s, _terms(s, d))


@query
def layer_hits_all(s, d):
    terms = search.query_terms(table(s, d, "eval_items").where("task is not null"), "task")
    return fusion.layer_hits(s, terms)


@query
def role_infer(s, d):
    return fusion.infer_roles(V.packages_now(s, d)).distinct()


@query
def package_weight(s, d):
    return fusion.package_weights(role_infer(s, d), layer_hits(s, d))


def _weighted(s, d):
    return fusion.weigh(_fused(s, d), V.files_now(s, d), package_weight(s, d))


@query
def weighted_fusion(s, d):
    return _weighted(s, d).select("file", "pkg", "score")


@query
def seed_ranking(s, d):
    return fusion.seeds(_weighted(s, d))


# Graph


@query
def edges_forward(s, d):
    return graph.degree_lists(V.edges_now(s, d), "src", "dst")


@query
def edges_reverse(s, d):
    return graph.degree_lists(V.edges_now(s, d), "dst", "src")


@query
def adjacency_forward(s, d):
    return graph.neighbours(V.edges_now(s, d), "src", "dst")


@query
def adjacency_reverse(s, d):
    return graph.neighbours(V.edges_now(s, d), "dst", "src")


@query
def symbol_index(s, d):
    return graph.symbol_index(V.symbols_now(s, d))


def _hubs(s, d):
    """(pos, file): the ten files with the most importers."""
    n = V.edges_now(s, d).groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n"))
    return fusion.seeds(n.select("file", F.lit("").alias("pkg"), F.col("n").cast("double").alias("score"), F.col("file").alias("list"), F.lit(1).alias("rank")), 10).select("pos", "file")


@query
def graph_expand_1hop(s, d):
    return graph.expand(cut(_hubs(s, d)), V.edges_now(s, d), 1)


@query
def graph_expand(s, d):
    return graph.expand(cut(_hubs(s, d)), V.edges_now(s, d), 2)


@query
def adjacency_bonus(s, d):
    files = table(s, d, "files").select("file").distinct()
    return graph.adjacency(files, _hubs(s, d), V.edges_now(s, d)).withColumn("bonus", F.round(graph.ADJACENCY_BONUS * F.col("adjacent"), 6))


@query
def alias_fixpoint(s, d):
    return graph.follow_aliases(V.edges_now(s, d).select(F.col("src").alias("name"), F.col("dst").alias("target")))


def _imports(s, d):
    """(src, spec, name): named imports of the code, with specifiers relative to the root."""
    found = F.regexp_extract_all("content", F.lit(r'import \{ (\w+) \} from "@/([^"]+)"'), F.lit(0))
    rows = _sources(s, d).select(F.col("file").alias("src"), F.explode(found).alias("i"))
    return rows.select("src", F.regexp_extract("i", r'"@/([^"]+)"', 1).alias("spec"), F.regexp_extract("i", r"\{ (\w+) \}", 1).alias("name")).distinct()


@query
def import_resolve(s, d):
    exact = table(s, d, "source_files").select("file").distinct()
    by_name = V.symbols_now(s, d).where("kind not in ('method', 'doc')").select("pkg", "name", "file").distinct()
    return graph.resolve_imports(_imports(s, d), exact, by_name)


@query
def import_statements(s, d):
    """Every import and re-export of the code, in all forms."""
    return graph.statements(_code(s, d)).select("src", "spec", "name", F.col("exported").isNotNull().alias("exported"))


def _code(s, d):
    return _sources(s, d).where(~paths.is_doc(F.col("file")))


@query
def import_targets(s, d):
    """The files that imports lead to: handed on, own file, index file or package."""
    found = cut(graph.statements(_code(s, d)))
    packages = V.packages_now(s, d)
    return graph.import_targets(found.select("src", "spec", "name"), found, table(s, d, "source_files").select("file"), packages, graph.symbol_index(V.symbols_now(s, d)))


@query
def cross_pkg_targets(s, d):
    """A function named through its package, with a path behind it, and the files that declare it there."""
    c = V.chunks_now(s, d).where("kind = 'function' and pkg is not null").select(F.concat("pkg", F.lit("/"), "symbol").alias("spec"), F.col("symbol").alias("name")).distinct()
    pkg = graph.specifier_packages(c, V.packages_now(s, d))
    return c.join(pkg, "spec").join(graph.symbol_index(V.symbols_now(s, d)), ["pkg", "name"]).select("spec", "name", "position", "file")


@query
def cross_pkg_resolve(s, d):
    own = V.symbols_now(s, d).where("kind not in ('method', 'doc') and pkg is not null")
    return own.groupBy("pkg", "name").agg(F.countDistinct("file").alias("files"), F.min("file").alias("first"))


# Manifest


def _lines_in_order(chunks):
    return chunks.withColumns({"start_line": F.least("start_line", "end_line"), "end_line": F.greatest("start_line", "end_line")})


@query
def matched_symbols(s, d):
    return man.matched_symbols(dense_topk(s, d), _lines_in_order(table(s, d, "chunks")))


@query
def whole_file_flag(s, d):
    return man.whole_file(V.files_now(s, d))


def manifest_of(s, d):
    files = V.files_now(s, d)
    dense = cut(dense_topk(s, d))  # at most TOP rows, read for the ranks and for the matched symbols
    lists = [search.ranked_files(dense), bm25_files(s, d), symbol_search(s, d).select("file", "rank")]
    weighted = cut(fusion.weigh(fusion.rrf(lists), files, package_weight(s, d)))
    return man.manifest(weighted, fusion.seeds(weighted), V.edges_now(s, d), files, man.matched_symbols(dense, _lines_in_order(table(s, d, "chunks"))))


@query
def manifest(s, d):
    return manifest_of(s, d)


@query
def manifest_detail(s, d):
    """The symbols matched in the manifest's files, with kind and lines."""
    return man.entries_symbols(manifest_of(s, d), matched_symbols(s, d))


@query
def render_summary(s, d):
    return man.render(manifest_of(s, d))


# Structure of the tree


@query
def glob_filter(s, d):
    return table(s, d, "files").select("file").distinct().where(paths.matches_any(F.col("file"), GLOBS))


@query
def scan_filter_owner(s, d):
    f = table(s, d, "source_files").select("file").distinct()
    kept = f.where(paths.is_ts(F.col("file")) & ~paths.matches_any(F.col("file"), EXCLUDED))
    return structure.owners(kept, V.packages_now(s, d))


@query
def longest_prefix_owner(s, d):
    return structure.owners(table(s, d, "files"), V.packages_now(s, d))


@query
def file_suffix(s, d):
    f = table(s, d, "files").select("file").distinct()
    return f.select("file", paths.dirname(F.col("file")).alias("dir"), paths.file_suffix(paths.basename(F.col("file"))).alias("suffix"))


def _ts(s, d):
    return table(s, d, "source_files").select("file").distinct().where(paths.is_ts(F.col("file")))


@query
def arch_map(s, d):
    return structure.profile(_ts(s, d), table(s, d, "source_files").select("file").distinct())


@query
def arch_template(s, d):
    return structure.templates(_ts(s, d), containers=True)


@query
def arch_template_own(s, d):
    """Templates of the directories that hold files themselves: only those have a profile."""
    return structure.templates(_ts(s, d))


@query
def arch_render(s, d):
    return structure.top_suffixes(_ts(s, d))


@query
def doc_sections(s, d):
    docs = _sources(s, d).where(paths.is_doc(F.col("file")))
    return structure.sections(docs).select("file", "section", "title", "start_line", "end_line", "name", F.md5("text").alias("text"))


@query
def line_slice(s, d):
    r = V.symbols_now(s, d).where("start_line <= end_line").select("file", "start_line", "end_line")
    return structure.slice_lines(_sources(s, d), r).select("file", "lines", F.md5("text").alias("text"))


@query
def chunk_project(s, d):
    c = V.chunks_now(s, d).where("start_line is not null and symbol is not null")
    return structure.project_chunks(c, "text").select("id", "signature", F.md5("text").alias("text"))


# Index and maintenance


@query
def symbol_extract(s, d):
    """The symbols of the indexed files, read from their texts; constants are told by use in ways that the table does not record."""
    known = table(s, d, "symbols").where("kind <> 'doc'").select("file").distinct()
    found = indexing.extract_symbols(_sources(s, d).join(known, "file", "left_semi"))
    return found.where("kind <> 'const'").select("file", "name", "kind", _long("start_line"), _long("end_line")).distinct()


@query
def index_from_sources(s, d):
    """Chunks by package and kind of an index that is made from the texts alone."""
    c = indexing.chunks_of(_sources(s, d), V.packages_now(s, d))
    return c.where("kind not in ('const', 'doc')").join(table(s, d, "symbols").where("kind <> 'doc'").select("file").distinct(), "file", "left_semi").groupBy("kind").agg(F.countDistinct("chunk_id").alias("n"))


#: Saved indexes of this session, by directory of tables.
_SAVED: dict[tuple[str, str], str] = {}


def _index(s, d):
    """The saved index of the tables; written once a session, into the folder for checkpoints."""
    key = (s.sparkContext.applicationId, d)
    if key not in _SAVED:
        root = f"{ensure_checkpoint_dir(s)}/index-{uuid.uuid4().hex}"
        maintenance.save(s, maintenance.build(V.chunks_now(s, d), V.vectors_now(s, d), V.edges_now(s, d), V.files_now(s, d)), root)
        _SAVED[key] = root
    return maintenance.load(s, _SAVED[key])


@query
def post_edit_refresh(s, d):
    """Chunks by kind of an index made from the texts, after one package's files were emptied and the short files deleted."""
    before = cut(_sources(s, d))
    files = V.files_now(s, d)
    packages = V.packages_now(s, d)
    index = maintenance.build(cut(indexing.chunks_of(before, packages)), V.vectors_now(s, d).limit(0), V.edges_now(s, d), files.select("file", "pkg", "mtime_ms", "n_lines", "is_doc"))
    emptied, gone = files.where(F.col("pkg") == HOT_PKG).select("file", F.lit("").alias("empty")), files.where("n_lines <= 20").select("file")
    after = cut(before.join(gone, "file", "left_anti").join(emptied, "file", "left").select("file", F.coalesce("empty", "content").alias("content")))
    now = indexing.refresh(index, before, after, packages)["chunks"].where("kind not in ('const', 'doc')")
    return now.join(table(s, d, "symbols").where("kind <> 'doc'").select("file").distinct(), "file", "left_semi").groupBy("kind").agg(F.countDistinct("chunk_id").alias("n"))


@query
def bm25_indexed(s, d):
    return search.top(search.bm25_indexed(_index(s, d), _terms(s, d)))


@query
def dense_indexed(s, d):
    i = _index(s, d)
    return search.top(search.dense(i["chunks"], i["vectors"], _query_vector(s, d)))


@query
def manifest_indexed(s, d):
    """The manifest from a saved index: no text of a chunk is read."""
    i = _index(s, d)
    dense = cut(dense_indexed(s, d))
    lists = [search.ranked_files(dense), search.ranked_files(bm25_indexed(s, d)), symbol_search(s, d).select("file", "rank")]
    weighted = cut(fusion.weigh(fusion.rrf(lists), i["files"], package_weight(s, d)))
    return man.manifest(weighted, fusion.seeds(weighted), i["edges"], i["files"], man.matched_symbols(dense, i["chunks"]), chunks=i["chunks"])


@query
def index_update(s, d):
    """Lengths of the chunks of a saved index after the files of one package lost their second half of chunks and those of few lines were deleted."""
    i = _index(s, d)
    files = i["files"].where(F.col("pkg") == HOT_PKG)
    deleted = i["files"].where("n_lines <= 20").select("file")
    now = i["chunks"].join(files.select("file"), "file", "left_semi").join(deleted, "file", "left_anti").where("ord % 2 = 0")
    new = maintenance.updated(i, now, i["vectors"].join(now.select("ord"), "ord", "left_semi"), i["edges"].join(files.select(F.col("file").alias("src")), "src", "left_semi"), files.join(deleted, "file", "left_anti"), deleted)
    root = f"{ensure_checkpoint_dir(s)}/index-{uuid.uuid4().hex}"
    maintenance.save(s, new, root)
    i = maintenance.load(s, root)
    return i["doclen"].join(i["postings"].groupBy("ord").agg(F.sum("tf").alias("tokens")), "ord", "left").select("ord", "file", "len", F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query
def build_index_stats(s, d):
    c = V.chunks_now(s, d)
    index = maintenance.build(c, V.vectors_now(s, d), V.edges_now(s, d), V.files_now(s, d))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, df in sorted(index.items()) if n != "stats"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def classify_changes(s, d):
    existing = table(s, d, "source_files").select("file")
    changed = existing.unionByName(table(s, d, "edges").select(F.col("dst").alias("file")))
    return maintenance.classify_changes(changed, existing)


def _affected(s, d):
    return V.files_now(s, d).where(F.col("pkg") == HOT_PKG).select("file")


@query
def incremental_upsert(s, d):
    """Chunk lengths after one package was indexed again: the same as building anew."""
    lengths = V.chunks_now(s, d).select("ord", "file", token_count(F.col("text")).alias("len"))
    fresh = lengths.join(_affected(s, d), "file", "left_semi").select("ord", "file", "len")
    return maintenance.upsert(lengths, fresh, _affected(s, d))


@query
def incremental_bm25(s, d):
    """Document frequencies after the files of one package were deleted."""
    c = V.chunks_now(s, d).join(_affected(s, d), "file", "left_anti")
    return search.doc_freq(search.postings(c))


@query
def incremental_edges(s, d):
    f = V.files_now(s, d)
    edges = V.edges_now(s, d)
    changed = f.where("n_lines >= 100").select("file")
    fresh = edges.join(changed.withColumnRenamed("file", "src"), "src", "left_semi").where("dst < src")
    return maintenance.update_edges(edges, fresh, changed, f.where("n_lines <= 20").select("file"))


@query
def stream_ingest(s, d):
    return ingest.latest_states(s, d)


@query
def stream_event_windows(s, d):
    return ingest.event_windows(s, d)


# Edit layer


@query
def parse_ops(s, d):
    """Each chunk as a stream of an edit, a rename and a deletion, with noise between."""
    c = V.chunks_now(s, d).where("symbol is not null").select("ord", "file", "symbol", "signature")
    text = F.concat(
        F.lit("Some talk.\nSTRUCTURAL_EDIT: "), "file", F.lit("#fn_"), "symbol", F.lit("\nACTION: set_body\n\nCODE:\n"), F.coalesce(F.regexp_replace("signature", r"\s+", " "), F.lit("none")),
        F.lit("\nCRITICAL_REFACTOR: RENAME "), "file", F.lit(" TO renamed\nDELETE_FILE: "), "file", F.lit("\nThe end."),
    )
    out = edits.parse_ops(c.select("ord", text.alias("stream")), "ord", "stream")
    return out.select("ord", _long("op_index"), "op_type", "node_id", "body", "new_name", "path")


@query
def node_ids(s, d):
    return edits.node_ids(V.symbols_now(s, d))


@query
def node_id_parse(s, d):
    n = node_ids(s, d).select("node_id", paths.parse_node_id(F.col("node_id")).alias("p"))
    return n.select("node_id", "p.path", "p.prefix", "p.name", "p.index")


@query
def anchor_resolve(s, d):
    files = table(s, d, "files").select("file").distinct()
    two = F.regexp_extract("file", r"([^/]+/[^/]+)$", 1)
    wanted = files.select(F.explode(F.array("file", paths.basename(F.col("file")), two)).alias("path")).where("path <> ''")
    return edits.resolve_anchors(wanted, files)


@query
def replace_text_unique(s, d):
    c = V.chunks_now(s, d).where("symbol is not null")
    return c.select("ord", F.md5(edits.replace_unique(F.col("text"), F.col("symbol"), F.lit("RENAMED"))).alias("text"))


@query
def rename_guards(s, d):
    sym = V.symbols_now(s, d).select("file", "name", "kind").distinct()
    first = sym.groupBy("file").agg(F.min("name").alias("lowest"))
    r = sym.join(first, "file").select("file", "name", F.when(F.col("kind") == "const", F.col("lowest")).otherwise(F.concat("name", F.lit("2"))).alias("new_name")).distinct()
    one_kind = sym.groupBy("file", "name").agg(F.min("kind").alias("kind"))
    return edits.rename_guards(r, one_kind)


@query
def delete_guard(s, d):
    return edits.delete_guard(table(s, d, "files"), table(s, d, "edges"))


@query
def create_guard(s, d):
    """Every second chunk's file, in its place and in a directory of its own, as a file to create."""
    c = V.chunks_now(s, d).where("ord % 2 = 0").select("file")
    wanted = c.select(F.col("file").alias("path")).distinct().unionByName(c.select(F.concat(F.lit("made/"), "file").alias("path")))
    return edits.create_files(table(s, d, "files"), wanted)


@query
def move_file_edges(s, d):
    moves = table(s, d, "files").where(F.col("file").startswith("libs/")).select(F.col("file").alias("from_path"), F.regexp_replace("file", "^libs/", "packages/").alias("to_path")).distinct()
    return edits.move_files(table(s, d, "edges").where("src is not null and dst is not null"), moves)


@query
def snapshot_diff(s, d):
    f = table(s, d, "files")
    first = f.groupBy("file").agg(F.min(F.struct("indexed_at", "mtime_ms", "n_lines")).alias("x")).select("file", "x.n_lines")
    now = V.files_now(s, d).where("not is_doc").select("file", "n_lines")
    return edits.snapshot_diff(first, now, "file", "n_lines")


def _diagnostics(s, d):
    c = V.chunks_now(s, d)
    return c.select("file", _long("start_line"), (F.length("text") % 7).cast("long").alias("code"), F.col("kind").alias("message"), "doc")


@query
def baseline_diff(s, d):
    now = _diagnostics(s, d)
    return edits.new_diagnostics(now.where("doc is not null"), now).select("file", "start_line", "code", "message").distinct()


@query
def range_anchor(s, d):
    lines = V.symbols_now(s, d).select("file", F.col("start_line").alias("line")).where("line is not null").distinct()
    ops = V.chunks_now(s, d).where("start_line is not null").select("file", F.col("ord").alias("op_index"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return edits.diagnostics_to_ops(lines, ops).select("file", _long("line"), "op_index")


# Evaluation


@query
def estimate_tokens(s, d):
    return V.chunks_now(s, d).select("ord", evaluation.estimate_tokens(F.col("text")).alias("tokens"))


@query
def token_reduction(s, d):
    """Tokens of the indexed chunks against those of the whole files, by package."""
    c = V.chunks_now(s, d).where("kind <> 'doc'").select("file", evaluation.chars_to_tokens(F.length("text")).alias("t")).groupBy("file").agg(F.sum("t").alias("part"))
    f = _sources(s, d).select("file", evaluation.chars_to_tokens(F.length("content")).alias("whole"))
    by = c.join(f, "file").join(V.files_now(s, d).select("file", "pkg"), "file").groupBy("pkg").agg(F.sum("part").alias("with_index"), F.sum("whole").alias("without"))
    return by.select("pkg", "with_index", "without", F.round(1 - F.col("with_index") / F.col("without"), 6).alias("saved"))


@query
def keyword_grep(s, d):
    return evaluation.keyword_grep(_sources(s, d), V.task(s, d))


def _batch_ranks(s, d):
    items = table(s, d, "eval_items").where("task is not null")
    terms = search.query_terms(items, "task", "item_id")
    scored = batch.best_files(V.chunks_now(s, d), terms, "item_id", search.TOP)
    # The best chunk of each file first: one row for each item and file, then the cut by rank.
    best = scored.groupBy("item_id", "file").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord")).alias("at"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("at")).cast("long")).where(F.col("rank") <= search.TOP)
    return ranked.select("item_id", "file", "rank", F.round(-F.col("at.s"), 6).alias("score"))


@query
def bm25_batch(s, d):
    return _batch_ranks(s, d)


@query
def eval_metrics_files(s, d):
    """Expected files as they are named: ranks of the files themselves."""
    return evaluation.metrics(evaluation.ranks(_batch_ranks(s, d).select("item_id", "file", "rank"), table(s, d, "eval_items").select("item_id", "layer", "expect"), search.TOP))


@query
def eval_metrics(s, d):
    """Expected files are matched by their package: items name files of the index only in part."""
    items = table(s, d, "eval_items")
    pkg = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 2), "/")
    ranked = _batch_ranks(s, d).select("item_id", pkg(F.col("file")).alias("file"), "rank")
    wanted = items.select("item_id", "layer", F.transform("expect", pkg).alias("expect"))
    return evaluation.metrics(evaluation.ranks(ranked, wanted, 8))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
