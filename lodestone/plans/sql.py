"""The same queries in DuckDB's SQL, written apart from the Spark plans; named parts are put together as needed."""

from __future__ import annotations

from lodestone.functions.paths import NODE_KINDS, glob_to_regex
from lodestone.functions.text import STOPWORDS
from lodestone.operators import fusion
from lodestone.operators.evaluation import KEYWORD_STOP
from lodestone.operators.structure import DOC_NAMES
from lodestone.plans.queries import EXCLUDED, GLOBS, HOT_PKG


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_HUMPS = r"string_split(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' ')"


def tokens(x: str) -> str:
    return (
        f"list_filter(flatten(list_transform(list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda w: w <> ''),"
        f" lambda w: CASE WHEN len({_HUMPS}) > 1 THEN list_concat([lower(w)], list_transform({_HUMPS}, lambda p: lower(p))) ELSE [lower(w)] END)),"
        f" lambda t: length(t) > 1 AND t NOT IN ({_list(STOPWORDS)}))"
    )


def _dir(x: str) -> str:
    return f"CASE WHEN contains({x}, '/') THEN regexp_replace({x}, '/[^/]*$', '') ELSE '' END"


def _base(x: str) -> str:
    return f"split_part({x}, '/', -1)"


def _suffix(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '^index\\.tsx?$') THEN 'index' WHEN regexp_matches({x}, '\\.[A-Za-z0-9-]+\\.tsx?$') THEN regexp_extract({x}, '(\\.[A-Za-z0-9-]+\\.tsx?)$', 1)"
        f" WHEN regexp_matches({x}, '^.+\\.[^.]*$') THEN regexp_extract({x}, '^.+(\\.[^.]*)$', 1) ELSE {x} END"
    )


def _any(x: str, globs) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{glob_to_regex(g)}')" for g in globs) + ")"


_TS = r"regexp_matches(file, '\.tsx?$') AND NOT regexp_matches(file, '\.d\.ts$')"
_DOC = r"regexp_matches(file, '\.mdx?$')"
_LAYER = ", ".join(f"('{r}', '{w}')" for r in fusion.ROLES for w in fusion.LAYER_TERMS[r])
_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(hay, '{p}')" for p in parts) + f" THEN '{role}'" for role, parts in fusion.NAME_PARTS.items()) + " ELSE 'unknown' END"
_DOT = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[])"
_NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
_QNORM = "sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))"

_STATEMENT = r"""(?m)^[ \t]*(?:import|export)\s[^;''"`()=:]*?\bfrom\s*["''][^"''\n]+["'']|^[ \t]*import\s*["''][^"''\n]+["'']"""

# Named parts; each may use those before it.
PARTS = {
    "cn": "SELECT * REPLACE (least(start_line, end_line) AS start_line, greatest(start_line, end_line) AS end_line, trim(pkg) AS pkg, coalesce(text, '') AS text) FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ord DESC) = 1",
    "fk": "SELECT file, max(trim(pkg)) AS known FROM files GROUP BY file",
    "fl": "SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file ORDER BY mtime_ms DESC NULLS LAST, indexed_at DESC NULLS LAST, n_lines DESC NULLS LAST, pkg DESC NULLS LAST) = 1",
    "fn": "SELECT fl.file, coalesce(trim(fl.pkg), fk.known) AS pkg, mtime_ms, n_lines, is_doc FROM fl JOIN fk ON fl.file = fk.file",
    "sn": "SELECT id, min(name) AS name, min(kind) AS kind, min(file) AS file, min(start_line) AS start_line, min(end_line) AS end_line, max(trim(pkg)) AS pkg FROM symbols GROUP BY id",
    "vn": "SELECT ord, min(embedding) AS embedding FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY ord",
    "en": "SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND dst IN (SELECT file FROM files)",
    "sf": "SELECT file, max(content) AS content FROM source_files GROUP BY file",
    "task": "SELECT task FROM eval_items ORDER BY item_id LIMIT 1",
    "qt": f"SELECT DISTINCT unnest({tokens('task')}) AS term FROM task",
    "post": f"SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({tokens('text')}) AS term FROM cn) GROUP BY ord, term",
    "dl": f"SELECT ord, file, len({tokens('text')}) AS len FROM cn",
    "df": "SELECT term, count(*) AS n FROM post GROUP BY term",
    "cs": "SELECT count(*) AS n_docs, coalesce(avg(len), 0) AS avgdl FROM dl",
    "bm": "SELECT post.ord, dl.file, round(sum(ln(1 + (n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score FROM post JOIN df USING (term) JOIN qt USING (term) JOIN dl ON dl.ord = post.ord, cs GROUP BY post.ord, dl.file",
    "bk": "SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, ord LIMIT 80",
    "bf": "SELECT file, row_number() OVER (ORDER BY s DESC, o) AS rank FROM (SELECT file, max(score) AS s, min(ord) FILTER (WHERE score = m) AS o FROM (SELECT *, max(score) OVER (PARTITION BY file) AS m FROM bk) GROUP BY file)",
    "qs": f"SELECT lower(task) AS q_text, {tokens('task')} AS q_tokens FROM task",
    "ss": f"SELECT file, len(list_filter({tokens('name')}, lambda t: list_contains(q_tokens, t))) + CASE WHEN length(name) >= 3 AND contains(q_text, lower(name)) THEN 2 ELSE 0 END AS score FROM sn, qs WHERE kind <> 'doc'",
    "sy": "SELECT file, score, row_number() OVER (ORDER BY score DESC, file) AS rank FROM (SELECT file, max(score)::BIGINT AS score FROM ss WHERE score > 0 GROUP BY file)",
    "qv": "SELECT embedding AS q FROM vn ORDER BY ord LIMIT 1",
    "dk": f"SELECT vn.ord, chunks.file, round({_DOT} / ({_NORM} * {_QNORM}), 6) AS score FROM vn JOIN chunks ON chunks.ord = vn.ord, qv ORDER BY score DESC, vn.ord LIMIT 80",
    "dv": "SELECT file, row_number() OVER (ORDER BY s DESC, o) AS rank FROM (SELECT file, max(score) AS s, min(ord) FILTER (WHERE score = m) AS o FROM (SELECT *, max(score) OVER (PARTITION BY file) AS m FROM dk) GROUP BY file)",
    "fu": "SELECT file, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list) AS list, arg_min(rank, list) AS rank FROM (SELECT file, rank, 0::BIGINT AS list FROM dv UNION ALL SELECT file, rank, 1 FROM bf UNION ALL SELECT file, rank, 2 FROM sy) GROUP BY file",
    "lw": f"SELECT * FROM (VALUES {_LAYER}) v(role, word)",
    "roles": f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in fusion.ROLES)}) v(role)",
    "lh": "SELECT roles.role, count(DISTINCT word) AS hits FROM roles LEFT JOIN (SELECT role, word FROM lw JOIN qt ON term = word OR (length(word) >= 4 AND starts_with(term, word))) h ON h.role = roles.role GROUP BY roles.role",
    "pk": "SELECT trim(name) AS name, trim(dir) AS dir, lower(trim(role)) AS role FROM packages",
    "ri": f"SELECT DISTINCT name, dir, CASE WHEN role IN ({_list(fusion.ROLES)}) THEN role ELSE {_ROLE} END AS role FROM (SELECT *, lower(concat_ws(' ', name, dir)) AS hay FROM pk)",
    "pw": "SELECT ri.name, ri.role, coalesce(hits, 0) AS hits, round(CASE WHEN coalesce(hits, 0) > 0 THEN 1 + 0.6::DOUBLE * hits / (SELECT max(hits) FROM lh) ELSE 1.0::DOUBLE END, 9) AS weight FROM ri LEFT JOIN lh ON lh.role = ri.role",
    "wf": "SELECT fu.file, fn.pkg, round(fu.score * coalesce(weight, 1.0::DOUBLE), 9) AS score, list, rank FROM fu LEFT JOIN fn ON fn.file = fu.file LEFT JOIN pw ON pw.name = fn.pkg",
    "se": "SELECT row_number() OVER (ORDER BY score DESC, list, rank) AS pos, file, pkg, score FROM wf ORDER BY score DESC, list, rank LIMIT 8",
    "hub": "SELECT row_number() OVER (ORDER BY n DESC, file) AS pos, file FROM (SELECT dst AS file, count(*) AS n FROM en GROUP BY dst ORDER BY n DESC, file LIMIT 10)",
    "links": "SELECT src AS at, dst AS file, 0 AS dir FROM en UNION ALL SELECT dst, src, 1 FROM en",
}


def _hops(seeds: str, p: str) -> dict[str, str]:
    """Two hops of expansion from a part (pos, file), unrolled."""
    first = "SELECT *, row_number() OVER (ORDER BY parent, dir, file) AS pos FROM (SELECT file, parent, dir FROM (SELECT b.file, s.pos AS parent, b.dir, row_number() OVER (PARTITION BY b.file ORDER BY s.pos, b.dir) AS r FROM links b JOIN {0} s ON s.file = b.at WHERE b.file NOT IN ({1})) WHERE r = 1)"
    return {
        f"{p}1": first.format(seeds, f"SELECT file FROM {seeds}"),
        f"{p}2": first.format(f"{p}1", f"SELECT file FROM {seeds} UNION ALL SELECT file FROM {p}1"),
    }


PARTS |= _hops("hub", "g") | _hops("se", "x")
_EXPANDED = "SELECT {h}::BIGINT AS hop, pos, file, CASE WHEN dir = 0 THEN 'imported-by-seed' ELSE 'imports-seed' END AS reason FROM {t}"
PARTS |= {
    "adj": "SELECT file, count(DISTINCT seed) AS adjacent FROM (SELECT src AS file, dst AS seed FROM en WHERE dst IN (SELECT file FROM se) UNION ALL SELECT dst, src FROM en WHERE src IN (SELECT file FROM se)) GROUP BY file",
    "mt": "SELECT chunks.file, symbol AS name, least(start_line, end_line) AS start_line, kind, greatest(start_line, end_line) AS end_line, d.ord, d.score FROM (SELECT * FROM dk ORDER BY score DESC, ord LIMIT 40) d JOIN chunks ON chunks.ord = d.ord WHERE kind <> 'doc'",
    "mo": "SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY file, name, start_line ORDER BY score DESC, ord) = 1",
    "ms": "SELECT file, row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) AS n, name, kind, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM mo QUALIFY n <= 6",
    "ca": f"SELECT file, 0::BIGINT AS hop, pos, CASE WHEN {_DOC} THEN 'doc' ELSE 'query-match' END AS reason FROM se UNION ALL SELECT file, hop, pos, reason FROM ({_EXPANDED.format(h=1, t='x1')} UNION ALL {_EXPANDED.format(h=2, t='x2')})",
    "sc": "SELECT ca.*, round(coalesce(wf.score, 0::DOUBLE) + 0.4::DOUBLE * coalesce(adjacent, 0), 9) AS score FROM ca LEFT JOIN wf ON wf.file = ca.file LEFT JOIN adj ON adj.file = ca.file",
    "kp": "SELECT * FROM sc WHERE hop = 0 UNION ALL SELECT * FROM (SELECT * FROM sc WHERE hop > 0 ORDER BY score DESC, hop, pos LIMIT 10)",
    "mn": "SELECT row_number() OVER (ORDER BY score DESC, hop, kp.pos) AS pos, kp.file, coalesce(fn.pkg, 'root') AS pkg, reason, score, coalesce(n_lines, 1000000) <= 50 AS whole, coalesce(m.symbols, '') AS symbols FROM kp LEFT JOIN fn ON fn.file = kp.file LEFT JOIN (SELECT file, string_agg(name, ',' ORDER BY n) AS symbols FROM ms GROUP BY file) m ON m.file = kp.file",
    "af": f"SELECT file FROM fn WHERE pkg = '{HOT_PKG}'",
    "ts": f"SELECT DISTINCT file, {_dir('file')} AS dir, {_suffix(_base('file'))} AS suffix FROM source_files WHERE {_TS}",
    "hist": "SELECT dir, suffix, count(*) AS n FROM ts GROUP BY dir, suffix",
    "ln": r"SELECT file, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS body, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM sf",
    "nid": f"SELECT file, start_line::BIGINT AS start_line, name, file || '#' || prefix || '_' || name || CASE WHEN i > 0 THEN '~' || i ELSE '' END AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY file, prefix, name ORDER BY start_line) - 1 AS i FROM (SELECT *, CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in NODE_KINDS.items())} END AS prefix FROM sn) WHERE prefix IS NOT NULL)",
    "im": r"""SELECT DISTINCT src, regexp_extract(i, '"@/([^"]+)"', 1) AS spec, regexp_extract(i, '\{ (\w+) \}', 1) AS name FROM (SELECT file AS src, unnest(regexp_extract_all(content, 'import \{ \w+ \} from "@/[^"]+"')) AS i FROM sf)""",
    "ex": "SELECT DISTINCT file FROM source_files",
    "st": r"""SELECT im.*, ex.file AS target, 1 AS stage FROM im JOIN ex ON regexp_replace(ex.file, '\.(tsx?|js)$', '') = spec UNION SELECT im.*, ex.file, 2 FROM im JOIN ex ON regexp_matches(ex.file, '/index\.(tsx?|js)$') AND regexp_replace(ex.file, '/index\.(tsx?|js)$', '') = spec
        UNION SELECT im.*, sn.file, 3 FROM im JOIN sn ON sn.pkg = spec AND sn.name = im.name WHERE kind NOT IN ('method', 'doc')""",
    "al": "SELECT src AS name, min(dst) AS target FROM en GROUP BY src",
    "qb": f"SELECT DISTINCT item_id, unnest({tokens('task')}) AS term FROM eval_items WHERE task IS NOT NULL",
    "bb": "SELECT item_id, post.ord, dl.file, round(sum(ln(1 + (n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score FROM post JOIN df USING (term) JOIN qb USING (term) JOIN dl ON dl.ord = post.ord, cs GROUP BY item_id, post.ord, dl.file",
    "bo": "SELECT item_id, file, ord, score FROM bb WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, file ORDER BY score DESC, ord) = 1",
    "br": "SELECT item_id, file, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS rank, score FROM bo QUALIFY rank <= 80",
    "rk": "SELECT e.item_id, layer, r.rank FROM eval_items e LEFT JOIN (SELECT br.item_id, min(rank) - 1 AS rank FROM br JOIN (SELECT item_id, unnest(expect) AS file FROM eval_items) w ON w.item_id = br.item_id AND regexp_extract(w.file, '^[^/]+/[^/]+') = regexp_extract(br.file, '^[^/]+/[^/]+') WHERE rank <= 8 GROUP BY br.item_id) r ON r.item_id = e.item_id",
    "dg": "SELECT file, start_line::BIGINT AS start_line, (length(text) % 7)::BIGINT AS code, kind AS message, doc FROM cn",
    "rn": "SELECT DISTINCT s.file, s.name, CASE WHEN kind = 'const' THEN lowest ELSE s.name || '2' END AS new_name FROM (SELECT DISTINCT file, name, kind FROM sn) s JOIN (SELECT file, min(name) AS lowest FROM sn GROUP BY file) l ON l.file = s.file",
    "ok1": "SELECT file, name, min(kind) AS kind FROM sn GROUP BY file, name",
    "anc": "SELECT DISTINCT file, unnest(list_concat(['.'], list_transform(generate_series(1, greatest(len(string_split(file, '/')) - 1, 1)), lambda n: array_to_string(string_split(file, '/')[1:n], '/')))) AS dir FROM files UNION SELECT DISTINCT file, unnest(list_concat(['.'], list_transform(generate_series(1, greatest(len(string_split(file, '/')) - 1, 1)), lambda n: array_to_string(string_split(file, '/')[1:n], '/')))) FROM source_files",
    "ow": "SELECT anc.file, arg_min(name, (-(CASE WHEN anc.dir = '.' THEN 0 ELSE length(anc.dir) END), name)) AS owner FROM anc JOIN pk ON pk.dir = anc.dir GROUP BY anc.file",
    "mk": r"SELECT file, n, body, regexp_extract(body, '^#{1,3}\s+(.+)', 1) AS title FROM ln WHERE regexp_matches(file, '\.mdx?$')",
    "sec": "SELECT *, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY n) AS section FROM mk",
    "sm": r"SELECT file, section, min(n) AS a, max(n) AS b, max(title) AS title, string_agg(body, chr(10) ORDER BY n) AS body FROM sec GROUP BY file, section HAVING regexp_matches(string_agg(body, chr(10) ORDER BY n), '\S')",
    "si": "SELECT pkg, name, row_number() OVER (PARTITION BY pkg, name ORDER BY file) AS position, file FROM (SELECT DISTINCT pkg, name, file FROM sn WHERE kind NOT IN ('method', 'doc') AND pkg IS NOT NULL AND name IS NOT NULL)",
    "ist": rf"""SELECT src, t, regexp_extract(t, '["'']([^"''\n]+)["'']$', 1) AS spec FROM (SELECT file AS src, unnest(regexp_extract_all(content, '{_STATEMENT}')) AS t FROM sf WHERE NOT {_DOC})""",
    "inm": r"""SELECT src, spec, regexp_matches(t, '^\s*export') AS exported, unnest(CASE WHEN len(n) > 0 THEN n ELSE [''] END) AS name FROM (SELECT src, spec, t, list_concat(
        CASE WHEN regexp_matches(t, '^\s*import\s+(?:type\s+)?[A-Za-z_$][\w$]*\s*(?:,|\s+from)') THEN ['default'] ELSE [] END,
        list_concat(CASE WHEN contains(t, '*') THEN [regexp_replace(regexp_extract(t, '(\*(?:\s*as\s+[\w$]+)?)', 1), '\s+', ' ', 'g')] ELSE [] END,
        list_filter(list_transform(string_split(regexp_extract(t, '\{([^}]*)\}', 1), ','), lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^type ', '')), lambda x: x <> ''))) AS n FROM ist)""",
    "stm": "SELECT DISTINCT src, spec, split_part(name, ' as ', 1) AS name, exported FROM inm",
    "mods": r"""SELECT DISTINCT file AS path, file AS target, 1 AS stage FROM source_files UNION SELECT regexp_replace(file, '(\.d)?\.[jt]sx?$', ''), file, 1 FROM source_files WHERE regexp_matches(file, '\.[jt]sx?$')
        UNION SELECT regexp_replace(file, '/?index\.[jt]sx?$', ''), file, 2 FROM source_files WHERE regexp_matches(file, '(^|/)index\.[jt]sx?$')""",
    "sp": "SELECT spec, arg_max(pk.name, length(pk.name)) AS pkg FROM (SELECT DISTINCT spec FROM stm UNION SELECT DISTINCT pkg || '/' || symbol FROM cn WHERE kind = 'function') x JOIN pk ON spec = pk.name OR starts_with(spec, pk.name || '/') GROUP BY spec",
    "imt": "SELECT src, spec, stm.name, target, stage FROM stm JOIN mods ON starts_with(spec, '@/') AND path = substring(spec, 3) WHERE src <> target UNION SELECT src, stm.spec, stm.name, file, 3 FROM stm JOIN sp ON sp.spec = stm.spec JOIN si ON si.pkg = sp.pkg AND si.name = stm.name WHERE src <> file",
    "mv": "SELECT DISTINCT file AS from_path, regexp_replace(file, '^libs/', 'packages/') AS to_path FROM files WHERE starts_with(file, 'libs/')",
}

_ORDER = list(PARTS)


def _with(final: str, **own: str) -> str:
    """Puts the parts that a statement uses, directly or through others, in front of it; `own` replaces some."""
    import re

    chosen = PARTS | own

    def used(text: str) -> set[str]:
        return {w for w in re.findall(r"(?:FROM|JOIN|,)\s+\(?\s*(\w+)", text) if w in PARTS}

    need, todo = set(), used(final)
    while todo:
        need |= todo
        todo = set().union(*(used(chosen[p]) for p in todo)) - need
    parts = ",\n".join(f"{p} AS ({chosen[p]})" for p in _ORDER if p in need)
    return f"WITH {parts}\n{final}" if parts else final


_DEG = "SELECT {k}, count(DISTINCT {o}) AS n, min({o}) AS first, max({o}) AS last FROM en GROUP BY {k}"
_SECTION_TITLE = r"CASE WHEN section = 0 THEN {b} ELSE regexp_replace(title, '^\s+|\s+$', '', 'g') END".format(b=_base("file"))

STATEMENTS = {
    "tokenize_chunks": f"SELECT ord, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT ord, {tokens('text')} AS t FROM cn)",
    "token_counts": f"SELECT doc_id, coalesce(len({tokens('text')}), 0) AS n FROM documents",
    "term_freq": "SELECT ord, term, tf FROM post",
    "doc_freq": "SELECT term, n FROM df",
    "corpus_stats": "SELECT n_docs, round(avgdl, 6) AS avgdl FROM cs",
    "bm25_topk": "SELECT ord, file, score FROM bk",
    "bm25_files": "SELECT file, rank FROM bf",
    "symbol_search": "SELECT file, score, rank FROM sy",
    "dense_topk": "SELECT ord, file, score FROM dk",
    "dense_files": "SELECT file, rank FROM dv",
    "cosine": f"SELECT ord, round({_DOT} / ({_NORM} * {_QNORM}), 6) AS cosine FROM vn, qv",
    "max_abs_diff": "SELECT ord, round(list_max(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda z: abs(z[1] - z[2]))), 6) AS diff FROM vn, qv",
    "l2_normalize": f"SELECT ord, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 6) AS first, round(v[-1], 6) AS last FROM (SELECT ord, list_transform(embedding::DOUBLE[], lambda x: x / ({_NORM} + 1e-32::DOUBLE)) AS v FROM vn)",
    "static_embed": "SELECT item_id, round(sqrt(sum(u * u)), 5) AS norm, round(max(u) FILTER (WHERE i = 1), 5) AS first, round(max(u) FILTER (WHERE i = 64), 5) AS last FROM (SELECT item_id, i, c / (sqrt(sum(c * c) OVER (PARTITION BY item_id)) + 1e-32::DOUBLE) AS u FROM (SELECT item_id, i, sum(m * w) / sum(w) AS c FROM qb JOIN (SELECT term, i, avg(x::DOUBLE) AS m, 1 / (1 + ln(count(*)::DOUBLE)) AS w FROM (SELECT term, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM (SELECT DISTINCT ord, term FROM post WHERE term IN (SELECT term FROM qb)) o JOIN vn ON vn.ord = o.ord) GROUP BY term, i) l ON l.term = qb.term GROUP BY item_id, i)) GROUP BY item_id",
    "rrf_fusion": "SELECT file, score, list, rank FROM fu",
    "layer_hits": "SELECT role, hits FROM lh",
    "layer_hits_all": "SELECT roles.role, count(DISTINCT word) AS hits FROM roles LEFT JOIN (SELECT role, word FROM lw JOIN (SELECT DISTINCT term FROM qb) q ON term = word OR (length(word) >= 4 AND starts_with(term, word))) h ON h.role = roles.role GROUP BY roles.role",
    "role_infer": "SELECT name, dir, role FROM ri",
    "package_weight": "SELECT name, role, hits, weight FROM pw",
    "weighted_fusion": "SELECT file, pkg, score FROM wf",
    "seed_ranking": "SELECT pos, file, pkg, score FROM se",
    "adjacency_forward": "SELECT src AS file, row_number() OVER (PARTITION BY src ORDER BY dst) AS position, dst AS neighbour FROM en",
    "adjacency_reverse": "SELECT dst AS file, row_number() OVER (PARTITION BY dst ORDER BY src) AS position, src AS neighbour FROM en",
    "symbol_index": "SELECT pkg, name, position, file FROM si",
    "import_statements": "SELECT src, spec, name, exported FROM stm",
    "import_targets": "SELECT src, spec, name, target, stage::BIGINT AS stage FROM imt QUALIFY stage = min(stage) OVER (PARTITION BY src, spec, name)",
    "cross_pkg_targets": "SELECT c.spec, c.name, position, file FROM (SELECT DISTINCT pkg || '/' || symbol AS spec, symbol AS name FROM cn WHERE kind = 'function' AND pkg IS NOT NULL) c JOIN sp ON sp.spec = c.spec JOIN si ON si.pkg = sp.pkg AND si.name = c.name",
    "symbol_extract": "SELECT DISTINCT file, name, kind, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM symbols WHERE kind NOT IN ('doc', 'const')",
    "index_from_sources": "SELECT kind, count(DISTINCT id) AS n FROM symbols WHERE kind NOT IN ('doc', 'const') GROUP BY kind",
    "post_edit_refresh": f"SELECT kind, count(DISTINCT id) AS n FROM symbols WHERE kind NOT IN ('doc', 'const') AND file NOT IN (SELECT file FROM fn WHERE n_lines <= 20) AND file NOT IN (SELECT file FROM fn WHERE pkg = '{HOT_PKG}') GROUP BY kind",
    "bm25_indexed": "SELECT ord, file, score FROM bk",
    "index_update": f"SELECT ord, file, len, len AS tokens FROM dl WHERE file NOT IN (SELECT file FROM fn WHERE n_lines <= 20) AND (file NOT IN (SELECT file FROM fn WHERE pkg = '{HOT_PKG}') OR ord % 2 = 0)",
    "eval_metrics_files": "SELECT layer, count(*) AS items, count(rank) AS passed, round(avg(rank), 6) AS mean_rank, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr FROM (SELECT e.item_id, layer, r.rank FROM eval_items e LEFT JOIN (SELECT br.item_id, min(rank) - 1 AS rank FROM br JOIN (SELECT item_id, unnest(expect) AS file FROM eval_items) w ON w.item_id = br.item_id AND w.file = br.file GROUP BY br.item_id) r ON r.item_id = e.item_id) GROUP BY layer",
    "edges_forward": _DEG.format(k="src", o="dst"),
    "edges_reverse": _DEG.format(k="dst", o="src"),
    "graph_expand_1hop": _EXPANDED.format(h=1, t="g1"),
    "graph_expand": f"{_EXPANDED.format(h=1, t='g1')} UNION ALL {_EXPANDED.format(h=2, t='g2')}",
    "adjacency_bonus": "SELECT f.file, coalesce(adjacent, 0) AS adjacent, round(0.4::DOUBLE * coalesce(adjacent, 0), 6) AS bonus FROM (SELECT DISTINCT file FROM files) f LEFT JOIN (SELECT file, count(DISTINCT seed) AS adjacent FROM (SELECT src AS file, dst AS seed FROM en WHERE dst IN (SELECT file FROM hub) UNION ALL SELECT dst, src FROM en WHERE src IN (SELECT file FROM hub)) GROUP BY file) a ON a.file = f.file",
    "alias_fixpoint": "SELECT a1.name, coalesce(a6.target, a5.target, a4.target, a3.target, a2.target, a1.target) AS target, 1 + (a2.name IS NOT NULL)::INT + (a3.name IS NOT NULL)::INT + (a4.name IS NOT NULL)::INT + (a5.name IS NOT NULL)::INT + (a6.name IS NOT NULL)::BIGINT AS steps FROM al a1 LEFT JOIN al a2 ON a2.name = a1.target LEFT JOIN al a3 ON a3.name = a2.target LEFT JOIN al a4 ON a4.name = a3.target LEFT JOIN al a5 ON a5.name = a4.target LEFT JOIN al a6 ON a6.name = a5.target",
    "import_resolve": "SELECT src, spec, name, target, stage::BIGINT AS stage FROM st QUALIFY stage = min(stage) OVER (PARTITION BY src, spec, name)",
    "cross_pkg_resolve": "SELECT pkg, name, count(DISTINCT file) AS files, min(file) AS first FROM sn WHERE kind NOT IN ('method', 'doc') AND pkg IS NOT NULL GROUP BY pkg, name",
    "matched_symbols": "SELECT file, n, name, kind, start_line, end_line FROM ms",
    "whole_file_flag": "SELECT file, coalesce(n_lines, 1000000) <= 50 AS whole FROM fn",
    "manifest": "SELECT pos, file, pkg, reason, score, whole, symbols FROM mn",
    "manifest_detail": "SELECT mn.pos, mn.file, ms.n, ms.name, ms.kind, ms.start_line, ms.end_line FROM mn JOIN ms ON ms.file = mn.file",
    "render_summary": "SELECT pos, rpad(reason, 16, ' ') || ' ' || printf('%.3f', score) || '  ' || file || CASE WHEN whole THEN '  (whole file)' ELSE '' END AS line FROM mn",
    "glob_filter": f"SELECT DISTINCT file FROM files WHERE {_any('file', GLOBS)}",
    "scan_filter_owner": f"SELECT f.file, owner FROM (SELECT DISTINCT file FROM source_files WHERE {_TS} AND NOT {_any('file', EXCLUDED)}) f LEFT JOIN ow ON ow.file = f.file",
    "longest_prefix_owner": "SELECT f.file, owner FROM (SELECT DISTINCT file FROM files) f LEFT JOIN ow ON ow.file = f.file",
    "file_suffix": f"SELECT DISTINCT file, {_dir('file')} AS dir, {_suffix(_base('file'))} AS suffix FROM files",
    "arch_map": f"SELECT h.dir, h.files, h.suffixes, d.doc FROM (SELECT dir, sum(n)::BIGINT AS files, array_to_string(list_sort(list(suffix || '=' || n)), ',') AS suffixes FROM hist GROUP BY dir) h LEFT JOIN (SELECT {_dir('file')} AS dir, arg_min({_base('file')}, list_position([{_list(DOC_NAMES)}], {_base('file')})) AS doc FROM (SELECT DISTINCT file FROM source_files) s WHERE {_base('file')} IN ({_list(DOC_NAMES)}) GROUP BY 1) d ON d.dir = h.dir",
    "arch_template": f"SELECT parent AS dir, array_to_string(list_sort(list(suffix)), ',') AS template, modules FROM (SELECT c.parent, c.suffix, modules, count(*) AS k FROM (SELECT DISTINCT dir, suffix, {_dir('dir')} AS parent FROM hist WHERE dir <> '') c JOIN (SELECT {_dir('dir')} AS parent, count(DISTINCT dir) AS modules FROM hist WHERE dir <> '' GROUP BY 1) m ON m.parent = c.parent WHERE modules >= 2 GROUP BY ALL HAVING count(*) >= ceil(modules / 2.0)) GROUP BY parent, modules HAVING count(*) >= 2",
    "arch_template_own": f"SELECT parent AS dir, array_to_string(list_sort(list(suffix)), ',') AS template, modules FROM (SELECT c.parent, c.suffix, modules, count(*) AS k FROM (SELECT DISTINCT dir, suffix, {_dir('dir')} AS parent FROM hist WHERE dir <> '') c JOIN (SELECT {_dir('dir')} AS parent, count(DISTINCT dir) AS modules FROM hist WHERE dir <> '' GROUP BY 1) m ON m.parent = c.parent WHERE modules >= 2 AND c.parent IN (SELECT dir FROM hist) GROUP BY ALL HAVING count(*) >= ceil(modules / 2.0)) GROUP BY parent, modules HAVING count(*) >= 2",
    "arch_render": "SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY n DESC, suffix) AS place, suffix, n FROM hist QUALIFY place <= 5",
    "doc_sections": f"SELECT file, section::BIGINT AS section, t AS title, a AS start_line, b AS end_line, substring({_base('file')} || ':' || t, 1, 80) AS name, md5(substring('doc ' || t || chr(10) || body, 1, 1500)) AS text FROM (SELECT *, {_SECTION_TITLE} AS t FROM sm)",
    "line_slice": "SELECT ln.file, count(*) AS lines, md5(string_agg(body, chr(10) ORDER BY ln.n)) AS text FROM ln JOIN (SELECT DISTINCT file, unnest(generate_series(start_line, end_line)) AS n FROM sn WHERE start_line <= end_line) r ON r.file = ln.file AND r.n = ln.n GROUP BY ln.file",
    "chunk_project": r"SELECT file || '#' || symbol || '@' || start_line AS id, substring(regexp_replace(split_part(regexp_replace(text, '^\s+', ''), chr(10), 1), '\s+$', ''), 1, 140) AS signature, md5(concat_ws(chr(10), concat_ws(' ', kind, symbol), CASE WHEN doc <> '' THEN doc END, CASE WHEN text <> '' THEN substring(text, 1, 1500) END)) AS text FROM cn WHERE start_line IS NOT NULL AND symbol IS NOT NULL",
    "build_index_stats": "SELECT 'chunks' AS part, count(*) AS n FROM cn UNION ALL SELECT 'postings', count(*) FROM post UNION ALL SELECT 'df', count(*) FROM df UNION ALL SELECT 'doclen', count(*) FROM dl UNION ALL SELECT 'vectors', count(*) FROM vn UNION ALL SELECT 'edges', count(*) FROM en UNION ALL SELECT 'files', count(*) FROM fn",
    "classify_changes": f"SELECT file, CASE WHEN file NOT IN (SELECT file FROM source_files) AND (({_TS}) OR {_DOC}) THEN 'deleted' WHEN {_TS} THEN 'changed-ts' WHEN {_DOC} THEN 'changed-doc' ELSE 'ignored' END AS change FROM (SELECT file FROM source_files UNION SELECT dst FROM edges) p",
    "incremental_upsert": "SELECT ord, file, len FROM dl",
    "incremental_bm25": f"SELECT term, count(DISTINCT ord) AS n FROM post JOIN dl USING (ord) WHERE file NOT IN (SELECT file FROM af) GROUP BY term",
    "incremental_edges": "SELECT DISTINCT src, dst FROM en WHERE (src NOT IN (SELECT file FROM fn WHERE n_lines >= 100) OR dst < src) AND src NOT IN (SELECT file FROM fn WHERE n_lines <= 20) AND dst NOT IN (SELECT file FROM fn WHERE n_lines <= 20)",
    "stream_ingest": "SELECT file, max(mtime_ms) AS mtime_ms, max(n_lines) FILTER (WHERE mtime_ms = m)::BIGINT AS n_lines FROM (SELECT *, max(mtime_ms) OVER (PARTITION BY file) AS m FROM files) GROUP BY file",
    "stream_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "parse_ops": r"SELECT ord, i::BIGINT AS op_index, t AS op_type, CASE i WHEN 0 THEN file || '#fn_' || symbol WHEN 1 THEN file END AS node_id, CASE i WHEN 0 THEN coalesce(regexp_replace(signature, '\s+', ' ', 'g'), 'none') END AS body, CASE i WHEN 1 THEN 'renamed' END AS new_name, CASE i WHEN 2 THEN file END AS path FROM cn, (VALUES (0, 'SET_BODY'), (1, 'RENAME'), (2, 'DELETE_FILE')) v(i, t) WHERE symbol IS NOT NULL",
    "node_ids": "SELECT file, start_line, name, node_id FROM nid",
    "node_id_parse": r"SELECT node_id, split_part(node_id, '#', 1) AS path, regexp_extract(node_id, '#([^_]*)_', 1) AS prefix, name, coalesce(try_cast(regexp_extract(node_id, '~(\d+)$', 1) AS BIGINT), 0) AS index FROM nid",
    "anchor_resolve": r"SELECT w.path, count(t.file) AS matches, coalesce(max(t.file) FILTER (WHERE t.file = w.path), CASE WHEN count(t.file) = 1 THEN min(t.file) END) AS file FROM (SELECT DISTINCT unnest([file, split_part(file, '/', -1), regexp_extract(file, '([^/]+/[^/]+)$', 1)]) AS path FROM files) w LEFT JOIN (SELECT DISTINCT file FROM files) t ON t.file = w.path OR ends_with(t.file, '/' || w.path) WHERE w.path <> '' GROUP BY w.path",
    "replace_text_unique": "SELECT ord, md5(CASE WHEN symbol <> '' AND len(string_split(text, symbol)) >= 2 AND strpos(substring(text, strpos(text, symbol) + 1), symbol) = 0 THEN replace(text, symbol, 'RENAMED') END) AS text FROM cn WHERE symbol IS NOT NULL",
    "rename_guards": "SELECT rn.file, rn.name, rn.new_name, CASE WHEN contains(rn.file, 'node_modules/') OR ends_with(rn.file, '.d.ts') THEN 'foreign' WHEN t.name IS NOT NULL THEN 'collision' WHEN ok1.kind NOT IN ('function', 'class', 'interface', 'type', 'enum', 'const', 'method') THEN 'kind' WHEN ok1.kind IS NULL THEN 'unknown' END AS refused FROM rn LEFT JOIN ok1 ON ok1.file = rn.file AND ok1.name = rn.name LEFT JOIN (SELECT DISTINCT file, name FROM sn) t ON t.file = rn.file AND t.name = rn.new_name",
    "delete_guard": "SELECT f.file, count(DISTINCT src) AS importers, count(DISTINCT src) = 0 AS allowed FROM (SELECT DISTINCT file FROM files) f LEFT JOIN (SELECT * FROM edges WHERE src <> dst) e ON e.dst = f.file GROUP BY f.file",
    "create_guard": "SELECT path, CASE WHEN path IN (SELECT file FROM files) THEN 'exists' WHEN count(*) > 1 THEN 'twice' END AS refused FROM (SELECT DISTINCT file AS path FROM cn WHERE ord % 2 = 0 UNION ALL SELECT 'made/' || file FROM cn WHERE ord % 2 = 0) GROUP BY path",
    "move_file_edges": "SELECT DISTINCT coalesce(a.to_path, src) AS src, coalesce(b.to_path, dst) AS dst FROM edges LEFT JOIN mv a ON a.from_path = src LEFT JOIN mv b ON b.from_path = dst WHERE src IS NOT NULL AND dst IS NOT NULL",
    "snapshot_diff": "SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT file, n_lines FROM files QUALIFY row_number() OVER (PARTITION BY file ORDER BY indexed_at NULLS FIRST, mtime_ms NULLS FIRST, n_lines NULLS FIRST) = 1) a FULL JOIN (SELECT file, n_lines FROM fn WHERE NOT is_doc) b ON b.file = a.file WHERE a.file IS NULL OR b.file IS NULL OR a.n_lines IS DISTINCT FROM b.n_lines",
    "baseline_diff": "SELECT DISTINCT file, start_line, code, message FROM dg WHERE concat_ws('::', file, code, message) NOT IN (SELECT concat_ws('::', file, code, message) FROM dg WHERE doc IS NOT NULL)",
    "range_anchor": "SELECT l.file, l.line::BIGINT AS line, min(ord) AS op_index FROM (SELECT DISTINCT file, start_line AS line FROM sn WHERE start_line IS NOT NULL) l JOIN cn ON cn.file = l.file AND l.line BETWEEN cn.start_line AND cn.end_line GROUP BY l.file, l.line",
    "estimate_tokens": r"""SELECT ord, greatest(1, floor(len(list_filter(regexp_split_to_array(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[\s.,;:(){}\[\]<>="''`+\-*/|&?!]+'), lambda p: p <> '')) * 1.3::DOUBLE + length(text) / 8.0::DOUBLE + 0.5::DOUBLE))::BIGINT AS tokens FROM cn""",
    "token_reduction": "SELECT fn.pkg, sum(part)::BIGINT AS with_index, sum(whole)::BIGINT AS without, round(1 - sum(part)::DOUBLE / sum(whole)::DOUBLE, 6) AS saved FROM (SELECT file, sum(floor(length(text) / 4.0::DOUBLE + 0.5::DOUBLE)) AS part FROM cn WHERE kind <> 'doc' GROUP BY file) c JOIN (SELECT file, floor(length(content) / 4.0::DOUBLE + 0.5::DOUBLE) AS whole FROM sf) w ON w.file = c.file JOIN fn ON fn.file = c.file GROUP BY fn.pkg",
    "keyword_grep": f"SELECT count(*) AS files, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM sf, (SELECT list_distinct(list_filter(regexp_split_to_array(lower(task), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ({_list(KEYWORD_STOP)}))) AS kw FROM task) k WHERE len(list_filter(kw, lambda x: contains(lower(content), x))) > 0",
    "bm25_batch": "SELECT item_id, file, rank, score FROM br",
    "eval_metrics": "SELECT layer, count(*) AS items, count(rank) AS passed, round(avg(rank), 6) AS mean_rank, round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr FROM rk GROUP BY layer",
}

_DOCS = f"""WITH cn AS (SELECT doc_id AS ord, coalesce(source, '') AS file, coalesce(text, '') AS text FROM documents),
task AS ({PARTS["task"]}), qt AS ({PARTS["qt"]}), post AS ({PARTS["post"]}), dl AS ({PARTS["dl"]}), df AS ({PARTS["df"]}), cs AS ({PARTS["cs"]}), bm AS ({PARTS["bm"]})
SELECT ord, file, score FROM bm WHERE score > 0 ORDER BY score DESC, ord LIMIT 80"""


def oracle_sql() -> dict[str, str]:
    # A saved index keeps the latest delivery of a chunk alone.
    kept = PARTS["dk"].replace("JOIN chunks ON chunks.ord", "JOIN cn AS chunks ON chunks.ord")
    indexed = {"dense_indexed": _with(STATEMENTS["dense_topk"], dk=kept), "manifest_indexed": _with(STATEMENTS["manifest"], dk=kept, mn=PARTS["mn"].replace("coalesce(fn.pkg, 'root')", "coalesce(fn.pkg, (SELECT min(pkg) FROM cn WHERE cn.file = kp.file), 'root')"))}
    return {name: _with(text) for name, text in STATEMENTS.items()} | indexed | {"bm25_documents": _DOCS}
