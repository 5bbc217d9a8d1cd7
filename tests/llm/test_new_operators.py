"""Vantage-point trees, filter audit and Merkle manifest against plain Python."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from llm_fixtures import no_rows, oracle, tables, texts  # noqa: F401
from ledgerline.llm import filter_audit, merkle, vp_trees
from ledgerline.llm.entry import ORACLES, QUERIES

#: queries that SQL can't express, and the test that recomputes their result
BRUTE_FORCE = {
    "op2_mixing": "test_llm_operators.py::test_mixing_targets_and_sizes",
    "op4_kd_shards": "test_llm_operators.py::test_kd_shards",
    "op6_pii": "test_llm_operators.py::test_pii",
    "op8_toxicity": "test_llm_operators.py::test_toxicity",
    "op9_packing": "test_llm_operators.py::test_packing",
    "op10_fingerprints": "test_llm_operators.py::test_fingerprints",
    "op11_vp_trees": "test_new_operators.py::test_neighbours_match_brute_force",
    "pipeline": "test_corpus_pipeline.py::test_stages",
}


def test_every_query_is_held_to_sql_or_brute_force():
    import os
    import __spark_entry__ as E
    from ledgerline.plans.driver_queries import QUERIES as REGISTRY
    without = set(E.queries()) - set(E.oracle_sql()) - set(REGISTRY)
    assert without == set(BRUTE_FORCE)
    here = os.path.dirname(__file__)
    for at in BRUTE_FORCE.values():
        name, test = at.split("::")
        assert re.search(rf"^def {test}", open(f"{here}/{name}").read(), re.M), at


# ---------------------------------------------------------------- neighbours
def brute_force(rows, step, k):
    """{query: [(vec_id, score)]} by definition, from (id, vector) pairs."""
    least = {}
    for i, v in rows:
        if i is None or v is None or len(v) == 0 or any(
                x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, dtype=np.float64) / max(abs(x) for x in v)
        v = v / np.sqrt((v * v).sum())
        if i not in least or tuple(v) < tuple(least[i]):
            least[i] = v
    out = {}
    for q, v in least.items():
        if q % step == 0:
            found = sorted((-float((v * w).sum()), i) for i, w in least.items()
                           if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return {q: f for q, f in out.items() if f}


def neighbours(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12, rtol=0)


def test_neighbours_match_brute_force(spark, tables):
    table = pq.read_table(f"{tables}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    want = brute_force(rows, 50, 5)
    got = neighbours(QUERIES["op11_vp_trees"](spark, tables))
    assert set(got) == set(want)
    hits = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.fixture()
def small_trees(monkeypatch):
    """Several cells, split cells, deep trees and blocks on a small table."""
    for name, value in (("CELL_ROWS", 150), ("SHARD_BYTES", 8 * 6 * 60), ("LEAF_ROWS", 4),
                        ("BLOCK_QUERIES", 7), ("CHUNK_QUERIES", 3)):
        monkeypatch.setattr(vp_trees, name, value)


def clustered(n, dim, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.2
    v[: n // 3] = centres[0]  # a third of all rows are one vector: ties
    return v


def test_factor_one_is_exact(spark, small_trees, tmp_path):
    v = clustered(600, 6)
    rows = [(i * 5 % 601, v[i].tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    forest = vp_trees.build(df, str(tmp_path / "index"))
    queries = spark.read.parquet(f"{forest.folder}/units").where("vec_id % 7 = 0")
    same(neighbours(vp_trees.search(forest, queries, 4)), brute_force(rows, 7, 4))
    points = forest.points.groupBy("cell", "part").count().collect()
    assert len(points) > 12 and max(r["count"] for r in points) < 150
    assert forest.points.count() == 600


def test_relaxed_search_compares_less_and_keeps_recall():
    v = clustered(4000, 8, 9)[2000:]
    v /= np.linalg.norm(v, axis=1)[:, None]
    order, rings = vp_trees.build_tree(v)
    assert sorted(order) == list(range(2000))
    compared, recall = [], []
    truth = np.argsort(-(v[order][:200] @ v[order].T) + np.eye(200, 2000) * 9, axis=1)[:, :5]
    for factor in (1.0, 3.0):
        s = vp_trees.Search(np.arange(2000), v[order], rings, np.arange(200), v[order][:200],
                            np.full(200, -np.inf), 5, factor)
        s.visit(0, 2000, np.arange(200))
        q, p, _ = s.result()
        hit = sum(len(set(p[q == i]) & set(truth[i])) for i in range(200))
        compared.append(s.compared)
        recall.append(hit / 1000)
    assert recall[0] == 1.0 and recall[1] >= 0.9
    assert compared[1] < compared[0] < 200 * 2000


def test_odd_vectors(spark, small_trees, tmp_path):
    """Nulls, zeros, non-finite parts, other lengths, repeated ids, huge values."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [2.0, 2.0]), (1, [0.0, 0.0]), (2, None),
            (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, []),
            (7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]),
            (150, [1.0, 2.0, 3.0]), (9, [3.0, 2.0, 1.0]), (200, [5.0]), (250, [1e300, 1e-300]),
            (300, None), (-50, [-1.0, 1.0]), (350, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("rank", "cell", "score", "unit", "dim", "query_id"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbours(QUERIES["op11_vp_trees"](spark, str(tmp_path)))
    same(got, brute_force(rows, 50, 5))
    assert 200 not in got and 300 not in got and got[150] == [(9, pytest.approx(10 / 14))]


# -------------------------------------------------------------- filter audit
def audit_by_hand(rows, labels):
    """{(part, order, step): counts} by applying the filters one after another."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    docs = []
    for doc, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": re.search(r"[#$%&*|]", t) is not None,
                 "E": doc is not None and any((u or "") == t and d is not None and d < doc
                                              for d, _, u in rows)}
        docs.append((lang or "", doc, fails))
    out = {}
    for part in {p for p, _, _ in docs}:
        mine = [(d, f) for p, d, f in docs if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                failing = [f for _, f in mine if f[letter]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone),
                    sum(sum(f.values()) == 1 for f in failing),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter]
        for letter in "ABCDE":
            keys = [k for k in out if k[0] == part and out[k][-1] == letter]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k][-1] = total
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_by_hand(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(220))
    rows = [(1, "en", long), (2, "en", long), (2, "en", long), (None, "en", long), (3, None, long),
            (4, "", "AB # c"), (5, "de", None), (0, "de", ""), (6, "de", long + " $"),
            (7, "fr", "go " * 300), (8, "fr", "go " * 300 + "#"), (9, "fr", "GO x " * 210),
            (10, "fr", "a\x0bb\x0cc\rd\te\nf " * 40), (10, "fr", "other text of the same id")]
    labels = [(1, 1, None), (1, 0, 1), (2, 1, 1), (4, 1, 0), (5, None, 1), (None, 1, 1), (8, 1, 1),
              (10, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for c in ("part", "mask", "n", "good", "toxic", "state", "step"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in
           QUERIES["op12_filter_audit"](spark, str(tmp_path)).collect()}
    assert got == audit_by_hand(rows, labels)


def test_gray_walk_stores_every_state():
    rng = np.random.default_rng(1)
    for k in (1, 3, 5):
        cells = {int(m): (int(rng.integers(0, 9)), int(rng.integers(0, 9)))
                 for m in rng.choice(1 << k, size=(1 << k) // 2 + 1, replace=False)}
        want = [tuple(sum(c[i] for m, c in cells.items() if not m & s) for i in (0, 1))
                for s in range(1 << k)]
        assert filter_audit.gray_walk(cells, k) == want


# ------------------------------------------------------------------- Merkle
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes, fanout=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(levels, i, fanout=2):
    for level in levels[:-1]:
        start = i - i % fanout
        yield level[start:i], level[i + 1:start + fanout]
        i //= fanout


def manifest_by_hand(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text); one result tuple per row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {g: sorted((r for r in rows if r[2] == g),
                       key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: levels_of([leaf(r) for r in order[g]], fanout) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs], fanout)
    root, out = top[-1][0], []
    for at, g in enumerate(langs):
        for i, r in enumerate(order[g]):
            path = [*steps(trees[g], i, fanout), *steps(top, at, fanout)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1 if tampered and r[3] is not None else r[3], r[4]))
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), trees[g][-1][0], root,
                        h(*[s for b, a in path for s in [*b, *a]]), node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOC = "doc_id long, source string, lang string, n_chars long, text string"


def sizes(n, lang):
    return [(i * 3, f"s{i % 2}", lang, i, f"text {i}") for i in range(n)]


@pytest.mark.parametrize("rows", [
    [(1, "s", "en", 1, "x")],
    sizes(2, "a") + sizes(3, "b") + sizes(16, "c") + sizes(17, None) + sizes(33, "") + sizes(1, "é"),
    sizes(257, "en"),
    [(7, "s", "en", 5, "same")] * 40 + [(None, None, None, None, None)] * 3
    + [(7, "s", "en", None, "日本" * 9000), (2 ** 62, "", "", 2 ** 63 - 1, ""),
       (-14, "s", "en", 0, "é")] + [(7, "s", "en", i, "t") for i in range(5)],
], ids=["lone", "sizes", "two pivots", "odd"])
def test_merkle_by_hand(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    for c in ("tree", "leaf", "pos", "size", "path", "root"):
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_merkle"](spark, str(tmp_path)).select(*COLUMNS).collect()
    want = manifest_by_hand(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({r["root"] for r in got}) == 1


def test_many_langs_and_wider_runs(spark, tmp_path):
    rows = [(i, "s", f"l{i % 23}", i, f"t{i}") for i in range(150)]
    docs = spark.createDataFrame(rows, DOC)
    got = merkle.manifest(merkle.leaves(docs), str(tmp_path / "m"), fanout=3)
    got = got.select("doc_id", "subroot", "root",
                     merkle.proof_digest(F.col("path")).alias("p"),
                     merkle.fold(F.col("leaf"), F.col("path")).alias("f")).collect()
    want = {r[0]: r for r in manifest_by_hand(rows, 3)}
    assert len(got) == 150
    for r in got:
        assert (r["subroot"], r["root"], r["p"]) == (want[r["doc_id"]][2:5])
        assert r["f"] == r["root"]
