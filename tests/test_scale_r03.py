"""Rows and memory of the searches on vectors whose radius reaches every cell."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from vellum.operators import density, knn, pivots
from vellum.session import cut_lineage


def _scattered(spark, n=400, dim=24):
    x = np.random.default_rng(4).normal(size=(n, dim))
    return x, spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)],
                                    "id long, vec array<double>, label int, g string")


def test_queries_move_once_for_a_tile(spark):
    """Not once for each of the cells, which all lie within the radius."""
    x, df = _scattered(spark)
    placed, cells = pivots.place(df, 8)
    asking = df.select("id", "g", "vec", F.lit(float("inf")).alias("r"))
    visiting = cut_lineage(pivots.visits(asking, cells, 0, 0, None))
    assert len(cells.part) > 16 and visiting.count() <= len(x) * (1 + len(x) // (8 * pivots.TILE_CELLS // 2))
    tiles = np.bincount(cells.tile)
    bits = sum(np.unpackbits(np.frombuffer(r.cells, np.uint8))[:tiles[r.tile]].sum() for r in visiting.select("tile", "cells").collect())
    assert bits == len(x) * len(cells.part)  # none is left out


def test_scattered_vectors_through_many_tiles(spark):
    x, df = _scattered(spark)
    nb = knn.knn_join(df, df, 4, qid="id", tid="id", qvec="vec", tvec="vec", label="label", exclude_self=True,
                      shared_train_bytes=0, cell_rows=3)
    got = {r.id: [n.tid for n in r.neighbors] for r in nb.collect()}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == np.argsort(d, kind="stable")[:4].tolist()


def test_long_vectors_make_small_tiles():
    """Tiles of rows alone would hold 65,536 x 4,096 doubles, 2 GB."""
    cells = pivots.Cells(np.zeros((2, 4096)), group=np.array([""] * 40, object), part=np.arange(40) % 2, ring=np.zeros(40, int),
                         block=np.arange(40) // 2, rows=np.full(40, 1024))
    cells.make_tiles(65_536)
    assert (np.bincount(cells.tile, weights=cells.rows) * 4096 * 8).max() <= 128 << 20
    assert len(set(zip(cells.tile.tolist(), cells.nth.tolist(), strict=True))) == 40


def test_ties_of_long_vectors_are_measured_in_small_batches():
    """38,400 pairs as near as the third: three tables of 2,048 doubles a pair are 1.9 GB."""
    q, t = np.ones((64, 2048)), np.zeros((600, 2048))
    tracemalloc.start()
    parts = list(knn.nearest_rows(np.arange(64), q, np.arange(600)[::-1], t, np.arange(600), 3, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and np.concatenate([p[1] for p in parts]).tolist() == [0, 1, 2] * 64


def test_doubles_in_one_piece_are_not_copied():
    lists = pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float64()))
    x = pivots.matrix(pa.chunked_array([lists]))
    assert x.tolist() == [[1, 2], [3, 4]] and np.shares_memory(x, lists.flatten().to_numpy())
    assert pivots.matrix(pa.chunked_array([lists, lists.cast(pa.list_(pa.float32())).cast(lists.type)])).tolist() == [[1, 2], [3, 4]] * 2


def test_small_tiles_find_the_same_rows(spark, monkeypatch):
    """Tiles and tasks of few bytes: every query still meets every cell that it needs."""
    monkeypatch.setattr(pivots, "TILE_BYTES", 24 * 8 * 20)
    monkeypatch.setattr(pivots, "QUERY_BYTES", 24 * 8 * 30)
    x, df = _scattered(spark)
    nb = knn.knn_join(df, df, 4, qid="id", tid="id", qvec="vec", tvec="vec", label="label", exclude_self=True, shared_train_bytes=0)
    got = {r.id: [n.tid for n in r.neighbors] for r in nb.collect()}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == np.argsort(d, kind="stable")[:4].tolist()


def test_forest_kernel_holds_no_wide_strip():
    """512 rows beside 40,000: the strip of distances stays a few megabytes."""
    rng = np.random.default_rng(1)
    frame = lambda name, n: pd.DataFrame({name: np.arange(n), "vec": list(rng.normal(size=(n, 4))),
                                          "cores": [[0.1]] * n})
    q, t = frame("qid", 512), frame("tid", 40_000)
    t.loc[:511, "vec"] = pd.Series(list(q["vec"]))
    tracemalloc.start()
    out = density._forest_kernel([(0, 0.05, 0), (1, 0.2, 0)])(q, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and set(out["cfg"]) == {1}


def _analysed(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_made_once(spark):
    """No filter of the planner's that makes each list again; items as before."""
    from vellum.operators.profile import list_item_counts
    df = spark.createDataFrame([("b a  a",), ("",), (None,), ("a _",)], "text string")
    out = list_item_counts(df.select(F.regexp_extract_all("text", F.lit("[a-z]+"), 0).alias("l")), "l")
    assert [(r.value, r["count"]) for r in out.collect()] == [("a", 3), ("b", 1)]
    assert _analysed(out).count("regexp_extract_all(") == 1


def test_texts_are_cut_into_terms_once_and_scores_stay(spark, monkeypatch):
    from vellum.operators import labels
    rows = [("g", 1, "red red blue"), ("g", 2, "blue green"), ("g", 2, "green"), ("h", 3, "red"), (None, 4, "red"), ("g", None, "red"),
            ("g", 5, " "), ("h", 6, None)]
    df = spark.createDataFrame(rows, "g string, id int, t string")
    plans = []
    monkeypatch.setattr(labels, "cut_lineage", lambda d: (plans.append(_analysed(d)), cut_lineage(d))[1])
    got = {(r.g, r.term): r.score for r in labels.tfidf_term_scores(df, "g", "id", "t", stop_words=()).collect()}
    assert plans[0].count("regexp_extract_all(") == 1
    n = 4  # texts of g
    idf = {t: np.log((n + 1) / (d + 1)) + 1 for t, d in (("red", 2), ("blue", 2), ("green", 1))}
    one, two = np.hypot(2 * idf["red"], idf["blue"]), np.hypot(idf["blue"], 2 * idf["green"])
    want = {("g", "red"): 2 * idf["red"] / one, ("g", "blue"): idf["blue"] / one + idf["blue"] / two,
            ("g", "green"): 2 * idf["green"] / two, ("h", "red"): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_profile_makes_rows_once(spark):
    from vellum.operators.profile import metadata_profile
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, "x", None), (2, "y", "E: a"), (3, None, "E: b")], "id int, c string, error string")
    out = {(r.section, r.name): r.value for r in metadata_profile(df.mapInArrow(mark, df.schema), ["c"]).collect()}
    assert out == {("present", "rows"): 3, ("present", "id"): 3, ("present", "c"): 2, ("present", "error"): 2, ("error", "E"): 2,
                   ("distinct", "c"): 2, ("top c", "x"): 1, ("top c", "y"): 1}
    assert seen.value == 3


def test_routed_texts_in_small_slices(spark):
    from vellum.operators.lang import language_routed
    most = spark.sparkContext.accumulator(0)

    def tag(code, texts):
        most.add(int(len(texts) > 1000))
        return code + ":" + texts

    df = spark.range(3000).select("id", F.lit("text").alias("t"), F.lit("de").alias("lang")).coalesce(1)
    df = df.unionByName(spark.createDataFrame([(-1, None, "fr"), (-2, "en", "en"), (-3, "no", None)], "id long, t string, lang string"))
    got = {r.id: r.t_en for r in language_routed(df, "lang", ["t"], tag).collect()}
    assert got[5] == "de:text" and got[-1] is None and got[-2] == "en" and got[-3] == "no" and len(got) == 3003
    assert most.value == 0


def test_topic_job_makes_cards_once(spark, monkeypatch):
    from vellum.plans import topics
    kept = []
    monkeypatch.setattr(topics, "cut_lineage", lambda d: (kept.append(d.columns), cut_lineage(d))[1])
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist(), f"word{i % 3} text") for i in range(12)],
                               "doc_id int, cluster_id int, embedding array<double>, full_text string")
    r = topics.topic_hierarchy(df, auto_tune=False, manual_threshold=0.5)
    assert r.cards.columns in kept and r.merged.columns in kept and r.cards.count() == 3
