import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import schedule, tags, text, vec
from tessera.operators import curation, greedy, learned, similarity
from tessera.plans import spec
from tessera.sources import tables
from tessera.streaming import events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = sorted(catalog.oracle_sql())


def plain(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    got = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(c) for c in df.columns]
    assert plain(df.collect()) == plain([tuple(r[k] for k in at) for r in got.fetchall()])


def test_two_meanings_of_angular(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.5, math.sqrt(3) / 2]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vec.angular(F.col("a"), F.col("b")), vec.angular_pi(F.col("a"), F.col("b"))).collect()
    assert row[0][0] == pytest.approx(0.5) and row[0][1] == pytest.approx(1 / 3) and row[1][0] is None


def test_tags_ties_and_malformed_pairs(spark):
    rows = [("a:0.5,b:0.5",), ("a:0,b:0",), ("a,b:,c:x,d:0.2",), (None,), ("a:0.1,a:0.9",)]
    got = spark.createDataFrame(rows, "t string").select(tags.top(F.col("t")), tags.score(F.col("t"), "a"), tags.first_top(F.col("t"), ["b", "a", "d"])).collect()
    assert [r[0] for r in got] == [None, None, "d", None, "a"]
    assert [r[1] for r in got] == [0.5, 0.0, 0.0, 0.0, 0.9]
    assert [r[2] for r in got] == ["b", None, "d", None, "a"]


def test_near_copies_within_and_across_batches():
    v = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.001]])
    assert greedy.keep_apart(v, 1) == [0, 1, 2]  # held against the last kept only
    many = np.stack([[math.cos(k), math.sin(k)] for k in range(60)] + [[math.cos(59), math.sin(59)]])
    assert 60 not in greedy.keep_apart(many, 1)  # in a batch against all kept there
    assert greedy.keep_apart(np.zeros((0, 2)), 1) == []


def test_walk_takes_an_author_once_a_bucket():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    author = ["x" if k < 30 else f"a{k}" for k in range(120)]
    out = greedy.walk(v, np.arange(120) / 120, author, 60)
    assert len(out) == len(set(out)) and sum(author[k] == "x" for k in out if k < 50) == 1


def test_order_and_mixture():
    assert sorted(greedy.order_items(np.array([90.0, 120, 100]), np.array([0.1, 0.9, 0.5]), ["C", "G", "D"])) == [0, 1, 2]
    w, m = learned.mixture(np.random.default_rng(1).normal(size=(40, 3)))
    assert w.sum() == pytest.approx(1) and m.shape[1] == 3


def test_index_recall(spark, sf_dir):
    assert learned.ivf_recall(spark, sf_dir).first().recall >= 0.9


def test_block_search_equals_single(spark, sf_dir):
    df = tables.vectors(spark, sf_dir)
    one = [r.item_id for r in similarity.neighbours(df.where("item_id <> 7"), similarity.seed_vector(df, 7), 5).collect()]
    assert one == [r.item_id for r in similarity.block_neighbours(df, df.where("item_id = 7"), 5).orderBy("dist").collect()]


def test_upsert_keeps_what_null_leaves(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k int, d int, s string")
    delta = spark.createDataFrame([(2, None, "c"), (3, None, "d")], "k int, d int, s string")
    assert plain(tables.upsert(base, delta, ["k"], ("d",)).collect()) == plain([(1, 5, "a"), (2, 6, "c"), (3, None, "d")])
    assert tables.replace_partition(base, delta, "k").count() == 3


def test_paths_and_titles(spark):
    row = spark.createDataFrame([("file:///mnt//Music/A%20b/01 x.MP3", "Song (Live) [x] - Remaster")], "p string, t string").select(text.path_tail(F.col("p")), text.clean_title(F.col("t"))).first()
    assert row[0] == "music/a b/01 x.mp3" and row[1] == "Song"


def test_plan(spark, sf_dir):
    found = spec.build(spark, sf_dir, '{"primaries": [{"kind": "similar", "item_id": 0, "k": 50}, {"kind": "all"}], "filter": {"tempo": [5, 45]}, "cap": 2, "limit": 30}').collect()
    assert 0 < len(found) <= 30 and max(sum(r.author == a for r in found) for a in {r.author for r in found}) <= 2
    with pytest.raises(ValueError):
        spec.build(spark, sf_dir, {"nonsense": 1})


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    s = events.stream(spark, str(tmp_path / "in"), batch.schema)
    events.to_table(events.tumbling(s), "t_counts", "complete", str(tmp_path / "c1"))
    got = spark.sql("SELECT event_type, sum(n) AS n FROM t_counts GROUP BY 1").collect()
    assert plain(got) == plain(batch.groupBy("event_type").count().collect())
    events.to_table(events.latest(s, "user_id"), "t_latest", "complete", str(tmp_path / "c2"))
    assert spark.sql("SELECT count(*) FROM t_latest").first()[0] == batch.select("user_id").distinct().count()


def test_schedules(spark):
    assert schedule.cron_field("*/20,5", 0, 59) == {0, 20, 40, 5} and schedule.cron_field("*", 1, 12) is None and schedule.cron_field("2-8/3", 0, 59) == {2, 5, 8}
    for wrong in ("60", "5-2", "*/0", "x"):
        with pytest.raises(ValueError):
            schedule.cron_field(wrong, 0, 59)
    at = spark.sql("SELECT timestamp_ntz'2024-01-07 03:15:00' AS t")  # a Sunday, the 7th
    fits = lambda e: at.select(schedule.cron(e, F.col("t"))).first()[0]
    assert fits("15 3 * * 0") and fits("15 3 * * 7") and fits("15 3 7 * 1") and not fits("15 3 8 * 1") and not fits("15 3 * 2 *")


def test_aligned_match_and_ring(spark):
    a = [k % 3 for k in range(60)]
    df = spark.createDataFrame([(a, a[2:] + [0, 0]), (a[:20], a[:20])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(vec.best_aligned(F.col("a"), F.col("b"), 12, 40)).collect()]
    assert got[0] == 1.0 and got[1] is None
    assert spark.range(1).select(schedule.ring(F.lit(11), F.lit(0)), schedule.ring(F.lit(0), F.lit(7))).first()[:] == (1, 5)


def test_guards(spark):
    df = spark.range(3)
    assert curation.unless_emptied(df, F.col("id") > 5).count() == 3 and curation.unless_emptied(df, F.col("id") > 1).count() == 1
    assert [r.id for r in curation.keyset_page_of(df, "id", 0, 1).collect()] == [1]


@pytest.mark.parametrize("on_driver", [0, 100_000])
def test_merge_runs_to_its_end(spark, monkeypatch, on_driver):
    monkeypatch.setattr(greedy, "DRIVER_PAIRS", on_driver)
    rng = np.random.default_rng(4)
    pairs = [(1, 2, 0.1), (1, 3, 0.3), (2, 3, 0.2)] + [(k, k + 1, 0.5) for k in range(10, 17)]
    pairs += sorted({(int(a), int(b)): (int(a), int(b), float(rng.integers(5))) for a, b in np.sort(rng.integers(100, 140, (120, 2)), axis=1) if a < b}.values())
    parent: dict[int, int] = {}
    for a, b, _ in sorted(pairs, key=lambda x: (x[1], x[2], x[0])):
        if b not in parent and a not in parent:
            parent[b] = a
    got = greedy.merge_pairs(spark.createDataFrame(pairs, "a_id long, b_id long, d double")).collect()
    assert {r.item_id: r.merged_into for r in got} == parent and len(got) == len(parent) and parent[3] == 1


def test_density_links_are_not_cut(spark):
    angle = [0.0] * 90 + [k * 1e-4 for k in range(1, 71)] + [0.4, 0.75, 0.78, 0.8, 1.1, 2.5]  # 160 within a hair, then a bridge, a cluster and noise
    v = np.array([[math.cos(x), math.sin(x)] for x in angle] + [[0.0, 0.0], [0.0, 0.0]])
    eps, least, n = 1 - math.cos(0.42), 3, len(angle)
    link = 1 - v[:n] @ v[:n].T <= eps
    np.fill_diagonal(link, False)
    core, label = link.sum(axis=1) >= least, np.arange(n)
    for _ in range(n):
        label = np.array([min([label[k], *label[link[k] & core]]) if core[k] else label[k] for k in range(n)])
    want = [label[k] if core[k] else min([label[j] for j in np.flatnonzero(link[k] & core)], default=-1) for k in range(n)] + [-1, -1]
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "item_id long, v array<double>").repartition(3)
    got = {r.item_id: r.cluster for r in learned.density_labels(df, eps, least).collect()}
    assert got == dict(enumerate(want)) and got[163] == 0 and got[165] == -1


def test_mixtures_take_all_rows_and_more_than_four_parts(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "x", [float(y) for y in rng.normal(size=4) + (40 if k % 4 == 0 else 0)]) for k in range(2400)]
    got = learned.author_mixtures(spark.createDataFrame(rows, "item_id long, author string, v array<double>")).collect()
    far = sum(r.weight for r in got if r.norm > 40)
    assert far == pytest.approx(600 / 2400, abs=1e-5)
    parts = np.concatenate([rng.normal(size=(40, 8)) + 30 * np.eye(8)[k] for k in range(8)])
    assert len(learned.mixture(parts)[0]) > 4
