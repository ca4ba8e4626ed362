"""SQL for the queries of the numbered problems that SQL can express.

The others (parsing, automata, alignment, packing, approximate search) are tested against
brute force, round trips and hand-made cases instead.
"""

from lodestone.plans.sql import tokens

_P5 = """
WITH w AS (SELECT ord, list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> '') AS w FROM chunks WHERE text IS NOT NULL),
s AS (SELECT DISTINCT ord, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT ord, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
n AS (SELECT ord, count(*) AS n FROM s GROUP BY ord),
p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.ord < b.ord GROUP BY 1, 2)
SELECT ord_a, ord_b FROM p JOIN n x ON x.ord = ord_a JOIN n y ON y.ord = ord_b WHERE c >= 0.5 * (x.n + y.n - c)
"""

ORACLES: dict[str, str] = {
    "p4_found": "SELECT DISTINCT ord FROM chunks WHERE length(text) > 1500",
    "p5_found": _P5,
    "p6_found": f"SELECT DISTINCT doc_id FROM documents WHERE len({tokens('text')}) > 512",
}
