"""Joins that look at few pairs only, against all pairs in plain Python."""

import random

import numpy as np

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import curation, relational


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_names_are_all_found(spark):
    r = random.Random(3)
    right = ["c" + "".join(r.choice("ab1") for _ in range(size)) + "07" for size in [*range(10, 64)]] + ["", "c", "07"]

    def harmed(x):
        for _ in range(r.randint(0, 4)):
            at = r.randint(1, max(1, len(x) - 3))
            x = x[:at] + r.choice(["", "z", "zz"]) + x[at + r.randint(0, 1) :]
        return x

    left = [harmed(x) for x in right if len(x) > 2 for _ in range(4)]
    want = {(m, n) for m in left for n in right if n and m[0] == n[0] and m[-2:] == n[-2:] and 100 * (1 - distance(m, n) / max(len(m), len(n))) >= 95}
    got = curation.close_names(spark.createDataFrame([(m,) for m in left], "m string"), spark.createDataFrame([(n,) for n in right], "n string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want and any(m != n and len(m) != len(n) for m, n in want)


def test_alike_names_are_all_found(spark):
    r = random.Random(4)
    rows = [(k, "".join(r.choice("ab ") for _ in range(r.randint(0, 14))) if k % 3 else f"Name#{k % 40:04d}é", k % 2) for k in range(160)] + [(200, None, 1), (201, "x", None)]
    df = spark.createDataFrame(rows, "id long, name string, cell int")
    for least in (0.8, 0.5):
        a, b = (df.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}n"), "cell") for s in "ab")
        want = a.join(b, "cell").where("a_id < b_id").where(text.trigram_similarity(F.col("an"), F.col("bn")) >= least).select("a_id", "b_id").collect()
        got = relational.alike(df, least).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_a_probe_moves_rows_and_not_pairs(spark, sf_dir, monkeypatch):
    from tessera.operators import learned
    from tessera.operators.similarity import block_neighbours
    from tessera.sources import index as store
    from tessera.sources.tables import vectors

    monkeypatch.setattr(store, "PART_ROWS", 100)  # several parts and several blocks of queries
    monkeypatch.setattr(store, "MAX_QUERIES", 10)
    df = vectors(spark, sf_dir)
    q = df.where("item_id % 20 = 0")
    indexed, centres = learned.build_index(df, cells=6)
    want = sorted((r.query_id, r.item_id, round(r.dist, 9)) for r in block_neighbours(df, q, 10).collect())
    found = learned.probe(indexed, centres, q, 10, 6)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.item_id, round(r.dist, 9)) for r in found.collect()) == want
    own = {r.item_id: r.cell for r in indexed.collect()}
    near = {int(r.item_id): {int(c) for c in store.nearest(np.array([r.v]), centres, 2)[0]} for r in q.collect()}
    two = learned.probe(indexed, centres, q, 10, 2).collect()
    assert all(own[r.item_id] in near[r.query_id] for r in two) and len(two) == 10 * len(near)


def test_confirmed_pairs_in_blocks_equal_all_pairs(spark, monkeypatch):
    from tessera.operators import library

    monkeypatch.setattr(library, "CONFIRM_ROWS", 7)  # several blocks of a cell and size
    r = random.Random(6)
    rows = [(k, r.randint(0, 1), r.randint(0, 3), r.choice(["x", "y", None]), [r.gauss(0, 1) for _ in range(3)]) for k in range(150)]
    rows += [(150, 0, 1, "x", [0.0, 0.0, 0.0]), (151, 0, 1, "y", None), (152, 0, 1, "y", [float("nan"), 1.0, 1.0])]
    unit = lambda v: np.array(v) / np.linalg.norm(v) if v and 0 < np.linalg.norm(v) else np.full(3, np.nan)
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 1]
    other = [(a, b) for a, b in pairs if None not in (a[3], b[3]) and a[3] != b[3]]
    near = [1 for a, b in other if 1 - unit(a[4]) @ unit(b[4]) <= 0.9]
    df = spark.createDataFrame(rows, "item_id long, cell int, size long, folder string, v array<double>")
    found = library.confirmed(df, 0.9)
    assert tuple(found.first()) == (len(pairs), len(other), len(near)) and tuple(library.confirmed(df.limit(0), 0.9).first()) == (0, 0, 0)


def test_density_labels_in_blocks_equal_those_of_all_links(spark, monkeypatch):
    from tessera.operators import learned

    monkeypatch.setattr(learned, "LINK_ROWS", 25)  # several blocks, a few rows of one at a time
    monkeypatch.setattr(learned, "LINK_STEP", 3)
    r = np.random.default_rng(7)
    angle = np.concatenate([np.sort(r.uniform(0, 6, 90)), np.repeat(r.uniform(0, 6, 5), 3)])
    rows = [(int(k), [float(np.cos(x)), float(np.sin(x))]) for k, x in zip(r.permutation(len(angle)), angle, strict=True)]
    v, eps, least = {k: np.array(x) for k, x in rows}, 0.0008, 3
    near = {a: {b for b in v if a != b and 1 - v[a] @ v[b] <= eps} for a in v}
    core = {a for a in v if len(near[a]) >= least}
    want = {a: a if a in core else -1 for a in v}
    for _ in v:
        want |= {a: min([want[a], *(want[b] for b in near[a] & core)]) for a in core}
    want |= {a: min((want[b] for b in near[a] & core), default=-1) for a in v if a not in core}
    df = spark.createDataFrame(rows, "item_id long, v array<double>")
    assert {x.item_id: x.cluster for x in learned.density_labels(df, eps, least).collect()} == want
    assert len(set(want.values())) > 4 and any(want[a] >= 0 for a in v if a not in core)
    # no more rows than a tree of each task and the links of rows that are no cores
    some = spark.createDataFrame([(k, [1.0, k / 1e6], 1) for k in range(100)], "item_id long, v array<double>, core int")
    assert learned.core_links(some, eps).count() < 100 * 6
