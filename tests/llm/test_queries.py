"""The registered queries over whole tables: columns, oracles and brute force."""

import itertools
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from themeweave.llm.looks import visual_form
from themeweave.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p1_found": ["cluster_id", "place", "benefit_id"],
    "p2_found": ["chunk_id", "field", "tech_id"],
    "p3_found": ["concern_id_a", "concern_id_b"],
    "p4_found": ["extraction_id", "defect"],
    "p5_found": ["chunk_id", "source_file"],
    "p6_found": ["track", "first_id", "phrase_id"],
    "p7_found": ["cluster_id", "technology_meta"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert QUERIES[name](spark, sf).columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    r = duck.execute(ORACLES[name])
    at = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted(tuple(x) for x in df.collect()) == sorted(tuple(x[i] for i in at) for x in r.fetchall())


@pytest.fixture(scope="module")
def units(duck):
    out = {}
    for track in ("concern", "benefit"):
        rows = {i: e for i, e in duck.execute(f"SELECT phrase_id, embedding FROM phrase_vectors WHERE track = '{track}' AND embedding IS NOT NULL AND len(embedding) = 96").fetchall()}
        good = {i: v for i, e in rows.items() if np.isfinite(v := np.array([np.nan if x is None else x for x in e], np.float32).astype(float)).all() and v.any()}
        ids = np.array(sorted(good))
        u = np.array([good[i] for i in ids])
        out[track] = ids, u / np.linalg.norm(u, axis=1, keepdims=True)
    return out


def test_p3_recall(spark, sf, units):
    ids, u = units["concern"]
    g = u @ u.T
    np.fill_diagonal(g, -1)
    want = set()
    for a in range(len(ids)):
        for b in np.argsort(-g[a], kind="stable")[:10]:
            if g[a, b] >= 0.955:
                want.add((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
    got = {tuple(r) for r in QUERIES["p3_found"](spark, sf).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 0


def test_p6_recall(spark, sf, units):
    want = set()
    for track, (ids, u) in units.items():
        near = u @ u.T >= 0.75
        want |= {(track, int(ids[near[a].argmax()]), int(ids[a])) for a in range(len(ids)) if near[a].sum() >= 3}
    got = {tuple(r) for r in QUERIES["p6_found"](spark, sf).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    described = QUERIES["p6_clusters"](spark, sf).collect()
    sizes = Counter((t, f) for t, f, _ in got)
    assert {(r.track, r.first_id): r["size"] for r in described} == sizes
    assert all(1 <= len(r.typical_ids.split(",")) <= 3 for r in described)


def test_p10_against_brute_force(spark, sf, duck):
    groups = defaultdict(list)
    for i, t in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        if visual_form(t).strip():
            groups[visual_form(t)].append((i, t))
    want = {(min(a[0], b[0]), max(a[0], b[0])) for g in groups.values() for a, b in itertools.combinations(g, 2) if a[1] != b[1]}
    assert {tuple(r) for r in QUERIES["p10_found"](spark, sf).collect()} == want and want


def test_p2_where_the_other_field_is_canonical(spark, sf, duck):
    names = dict(duck.execute("SELECT name, tech_id FROM technologies").fetchall())
    rows = {c: (a, b) for c, a, b in duck.execute("SELECT chunk_id, technology, technology_meta FROM chunks").fetchall()}
    found = QUERIES["p2_found"](spark, sf).collect()
    assert len({(r.chunk_id, r.field) for r in found}) == len(found)
    right = wrong = 0
    for r in found:
        a, b = rows[r.chunk_id]
        own, other = (a, b) if r.field == "technology" else (b, a)
        assert own is not None and own.strip() and own not in names
        if other in names and r.tech_id:
            right += r.tech_id == names[other]
            wrong += r.tech_id != names[other]
    assert right > 100 and wrong == 0


def test_p9_is_well_filled(spark, sf, duck):
    rows = QUERIES["p9_packing"](spark, sf).collect()
    capacity = dict(duck.execute("SELECT container_kind, capacity_tokens FROM containers").fetchall())
    docs = duck.execute("SELECT count(DISTINCT doc_id) FROM documents").fetchone()[0]
    for kind, cap in capacity.items():
        mine = [r for r in rows if r.container_kind == kind]
        load = Counter()
        for r in mine:
            load[r.container] += r["size"]
        assert len({r.doc_id for r in mine}) == docs and max(load.values()) <= cap
        assert sum(load.values()) >= 0.98 * cap * (len(load) - 1)


def test_p4_defects_are_of_their_kind(spark, sf, duck):
    got = {r.extraction_id: r.defect for r in QUERIES["p4_found"](spark, sf).collect()}
    rows = {i: (p or [], s) for i, p, s in duck.execute("SELECT extraction_id, raw_phrases, sentinel_returned FROM extractions").fetchall()}
    empty = {i for i, (p, s) in rows.items() if not s and not any(any(c.isalpha() for c in x or "") for x in p)}
    assert {i for i, d in got.items() if d == "empty"} == empty
    assert set(got.values()) == {"empty", "refusal", "truncated", "copy", "language"}
    assert 0.01 < len(got) / len(rows) < 0.2
