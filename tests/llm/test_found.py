"""The registered queries on the smallest tables: SQL where there is some, brute force for the rest."""

import os

import numpy as np
import pytest

from lodestone.llm import queries
from tests.oracle import connect, same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
FOUND = {"p1_found": ["file", "name"], "p2_found": ["file"], "p3_found": ["ord_a", "ord_b"], "p4_found": ["ord"], "p5_found": ["ord_a", "ord_b"], "p6_found": ["doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    same(spark, duck, DATA, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == FOUND[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


def test_neighbours_against_brute_force(spark, duck):
    rows = duck.execute("select ord, min(embedding) from vectors where len(embedding) = 64 group by ord order by ord").fetchall()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    keep = np.linalg.norm(x, axis=1) > 0
    ids, x = ids[keep], x[keep] / np.linalg.norm(x[keep], axis=1, keepdims=True)
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -9)
    want = {(min(int(a), int(ids[j])), max(int(a), int(ids[j]))) for a, s in zip(ids, sims) for j in np.lexsort((ids, -s))[:10]}
    got = {(r["ord_a"], r["ord_b"]) for r in queries.queries()["p3_found"](spark, DATA).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_pieces_lose_nothing(spark, duck):
    texts = dict(duck.execute("select ord, text from chunks where text is not null").fetchall())
    pieces = {}
    for r in queries.queries()["p4_pieces"](spark, DATA).collect():
        pieces.setdefault(r["ord"], []).append(r)
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert own[0]["start_char"] == 0 and own[-1]["end_char"] == len(texts[key])
        for r in own:
            assert r["text"] == texts[key][r["start_char"] : r["end_char"]] and len(r["text"]) <= 1500 and r["pieces"] == len(own)
            assert r["start_line"] is None or r["start_line"] <= r["end_line"]
        assert all(b["start_char"] == a["end_char"] - 150 for a, b in zip(own, own[1:]))


def test_packing_is_whole(spark, duck):
    sizes = dict(duck.execute("select doc_id, 0 from documents").fetchall())
    packed = queries.queries()["p6_packing"](spark, DATA).collect()
    load, parts = {}, {}
    for r in packed:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["doc_id"], []).append(r)
    assert set(parts) == set(sizes) and max(load.values()) <= 512
    assert all(len(own) == own[0]["pieces"] and {r["piece"] for r in own} == set(range(len(own))) for own in parts.values())
    fill = queries.queries()["p6_fill"](spark, DATA).first()
    assert fill["filled"] > 0.9
