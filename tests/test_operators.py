import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inkstream.functions import recognition as rec
from inkstream.functions import text as tx
from inkstream.functions.observations import observations, to_json
from inkstream.operators import generators as gen
from inkstream.operators import heatmap
from inkstream.operators import geometry as geo
from inkstream.operators import ranking as rank
from inkstream.operators.heatmap import _label
from inkstream.operators.tracks import assign, solve_assignment
from pyspark.sql import functions as F


def test_letterbox_golden(spark):
    r = spark.createDataFrame([(1920, 1080)], "w int, h int").select(*geo.letterbox("w", "h", 640, 480)).first()
    assert tuple(r) == (640, 360, 0, 60)


def test_tile_golden(spark):
    r = gen.tiles(spark.createDataFrame([(1, 1920, 1080)], "image_id int, width int, height int")).orderBy("tile_id").collect()
    assert [(x.x1, x.y1, x.x2 - x.x1, x.y2 - x.y1) for x in r] == [(0, 0, 1280, 960), (1240, 0, 1280, 960), (0, 920, 1280, 960), (1240, 920, 1280, 960)]


def test_collapse_golden(spark):
    rows = [(1, t, k, 0.9) for t, k in enumerate([0, 0, 0, 3589, 0, 0, 4544, 0, 0, 4547])]
    r = rec.collapse(spark.createDataFrame(rows, "image_id int, t int, k int, score double")).orderBy("t").collect()
    assert [x.dict_idx for x in r] == [3588, 4543, 4546]


def test_mean_golden(spark):
    c = [0.9794, 0.9971, 0.9882, 0.9971, 0.7279, 0.5382, 0.9441, 0.8691, 0.9618, 0.9926, 0.9971]
    assert round(spark.createDataFrame([(c,)], "c array<double>").select(rec.mean_confidence(F.col("c"))).first()[0], 4) == 0.9084


def test_time_and_growth_goldens(spark):
    df = spark.createDataFrame([("2025-03-07T09-05-41+08-00.jpg",), ("x.jpg",)], "n string")
    assert [r[0] for r in df.select(tx.captured_at("n")).collect()] == ["2025-03-07T09:05:41+08:00", None]
    b = spark.range(1).select(*geo.expand_by_height(F.lit(100), F.lit(100), F.lit(200), F.lit(140), F.lit(1000), F.lit(1000))).first()
    assert tuple(b) == (86, 86, 214, 154)


def test_merge_golden():
    assert tx.merge_pair("hello w", "world") == "hello world"
    assert tx.merge_all(["hello w", "world"], "bytes") == "hello world"
    assert tx.merge_all([]) == ""


@given(st.text(max_size=8), st.text(max_size=8))
def test_merge_properties(a, b):
    assert tx.merge_pair("", b) == b and tx.merge_pair(a, "") == a
    assert len(tx.merge_pair(a, b)) <= len(a) + len(b)
    assert len(tx.merge_strategies(a, b)) <= len(a) + len(b)
    tx.merge_all([a, b], "bytes")


@settings(max_examples=60)
@given(st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_cheapest(n, seed):
    cost = np.random.default_rng(seed).random((n, n)).round(2)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    assert abs(cost[np.arange(n), solve_assignment(cost)].sum() - best) < 1e-9


@settings(max_examples=60)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 10_000))
def test_limited_assignment(rows, cols, seed):
    cost, limit = np.random.default_rng(seed).random((rows, cols)), 0.6
    pairs, a, b = assign(cost, limit)
    total = lambda ps: sum(cost[i, j] for i, j in ps) + limit / 2 * (rows + cols - 2 * len(ps))
    every = [[]]
    for k in range(1, min(rows, cols) + 1):
        every += [list(zip(r, c, strict=True)) for r in itertools.combinations(range(rows), k) for c in itertools.permutations(range(cols), k)]
    assert total(pairs) <= min(map(total, every)) + 1e-9
    assert len(pairs) + len(a) == rows and len(pairs) + len(b) == cols


def test_suppression_property(spark, folder):
    from inkstream.plans.fixtures import Inputs

    d = Inputs(spark, folder).detection()
    kept = rank.suppress(d, 0.1).toPandas()
    all_ = d.toPandas()

    def iou(p, q):
        w, h = min(p.x + p.w, q.x + q.w) - max(p.x, q.x), min(p.y + p.h, q.y + q.h) - max(p.y, q.y)
        return w * h / (p.w * p.h + q.w * q.h - w * h) if w > 0 and h > 0 else 0

    for key, g in kept.groupby(["stream_id", "frame_id"]):
        rows = list(g.itertuples())
        assert all(iou(p, q) <= 0.1 for p, q in itertools.combinations(rows, 2))
        have = {r.idx for r in rows}
        for o in all_[(all_.stream_id == key[0]) & (all_.frame_id == key[1])].itertuples():
            assert o.idx in have or any(iou(o, q) > 0.1 and (q.score, -q.idx) > (o.score, -o.idx) for q in rows)


@settings(max_examples=50)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1))
def test_labels_are_connected_regions(points):
    p = sorted(points)
    got = _label(np.array([a for a, _ in p]), np.array([b for _, b in p]))
    parent = {q: q for q in p}

    def find(q):
        while parent[q] != q:
            q = parent[q]
        return q

    for a, b in itertools.combinations(p, 2):
        if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1:
            parent[find(a)] = find(b)
    assert all((got[i] == got[j]) == (find(p[i]) == find(p[j])) for i in range(len(p)) for j in range(len(p)))


def test_observation_of_no_blocks(spark):
    blocks = spark.createDataFrame([], "image_id int, ord int, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    r = observations(blocks, spark.createDataFrame([(1, 10, 20)], "image_id int, width int, height int")).select(to_json()).first()[0]
    assert '"block_count":0' in r and '"captured_at":null' in r


def test_text_helpers(spark):
    df = spark.createDataFrame([("/a/b.c/x_ocr.jpg",), ("y",), ("_ocr.jpg",)], "p string")
    r = df.select(tx.processed("p"), tx.directory("p"), tx.ending("p"), tx.is_image("p")).collect()
    assert [tuple(x) for x in r] == [(True, "/a/b.c", ".jpg", True), (False, ".", "", False), (False, ".", ".jpg", True)]
    assert spark.range(1).select(tx.visible_bytes(F.lit("aé"))).first()[0] == "a[0xC3][0xA9]"


def test_box_confidence_by_summed_areas(spark):
    """Random pictures and boxes, some beyond the pixels, against the mean of each box's hot pixels."""
    r = np.random.default_rng(3)
    pixels = [(i, 0, int(y), int(x), float(v)) for i in range(4) for y, x, v in zip(r.integers(0, 30, 200), r.integers(5, 40, 200), r.random(200), strict=True)]
    boxes = [(i, k, int(x), int(y), int(x + w), int(y + h)) for i in range(5) for k, (x, y, w, h) in enumerate(zip(r.integers(-3, 45, 40), r.integers(-3, 35, 40), r.integers(1, 20, 40), r.integers(1, 20, 40), strict=True))]
    got = heatmap.box_confidence(spark.createDataFrame(boxes, "image_id int, label int, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame(pixels, "image_id int, tile_id int, y int, x int, val float"), 0.4)
    top = {}
    for i, _, y, x, v in pixels:
        if np.float32(v) > np.float32(0.4):
            top[i, y, x] = max(top.get((i, y, x), 0.0), float(np.float32(v)))
    want = {}
    for i, k, x1, y1, x2, y2 in boxes:
        inside = [v for (j, y, x), v in top.items() if j == i and x1 <= x < x2 and y1 <= y < y2]
        if inside:
            want[i, k] = sum(inside) / len(inside)
    found = {(x.image_id, x.label): x.confidence for x in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_suppression_across_batches_and_nulls(spark):
    """Frames that go on over Arrow batches, null keys, scores and sides: as box by box."""
    r = np.random.default_rng(5)
    rows = [(int(g) if g else None, int(i), float(x), float(y), 10.0, 10.0, float(s)) for i, (g, x, y, s) in enumerate(zip(r.integers(0, 4, 300), r.integers(0, 60, 300), r.integers(0, 60, 300), r.random(300).round(1), strict=True))]
    rows += [(1, 900, 5.0, 5.0, None, 10.0, 0.99), (1, 901, 5.0, 5.0, 10.0, 10.0, None)]
    df = spark.createDataFrame(rows, "frame_id int, idx int, x double, y double, w double, h double, score double")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x.frame_id, x.idx) for x in rank.suppress(df, 0.2, ("frame_id",)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    want, kept = set(), {}
    for g, i, x, y, w, h, s in sorted(rows, key=lambda q: (q[6] is None, -(q[6] or 0), q[1])):
        over = False
        for X, Y, W, H in kept.setdefault(g, []):
            if None not in (w, W):
                iw, ih = min(x + w, X + W) - max(x, X), min(y + h, Y + H) - max(y, Y)
                over |= iw > 0 and ih > 0 and iw * ih / (w * h + W * H - iw * ih) > 0.2
        if not over:
            kept[g].append((x, y, w, h))
            want.add((g, i))
    assert got == want


def texts_to_merge(n=300):
    import random

    r, rows = random.Random(1), []
    for i in range(n):
        letters = "abAB é😀" if i % 2 else "abcdefghijkl"
        rows.append((i, [None if r.random() < 0.05 else "".join(r.choice(letters) for _ in range(r.choice((0, 1, 2, 3, 5, 20)))) for _ in range(r.randrange(0, 50))]))
    return [*rows, (n, None), (n + 1, ["ab" * 200, "b" * 300, "xy"])]


def test_native_folds_are_the_pairs_in_turn(spark):
    rows = texts_to_merge()
    df = spark.createDataFrame(rows, "i int, p array<string>").select("i", tx.merge_texts("p").alias("a"), tx.merge_texts_older("p").alias("b"))
    got = {x.i: (x.a, x.b) for x in df.collect()}
    for i, p in rows:
        older = ""
        for x in p or []:
            older = tx.merge_strategies(older, x or "")
        assert got[i] == ((tx.merge_all(p), older) if p is not None else (None, None))


def test_folds_cost_what_is_added(monkeypatch):
    """Long texts of many doubled parts, which every step without an overlap used to look at whole: settled parts are set aside and taken back."""
    import random

    r = random.Random(5)
    for long, letters in ((4096, "abcdefghijkl"), (90, "abcdefghijkl"), (20, "abcd")):
        monkeypatch.setattr(tx, "_LONG", long)
        texts, older = ["".join(r.choice(letters) * r.choice((1, 1, 2, 4)) for _ in range(r.randrange(1, 9))) for _ in range(400)], ""
        for x in texts:
            older = tx.merge_strategies(older, x)
        assert tx.merged(texts, True) == older and tx.merged(texts) == tx.merge_all(texts)
    looked = []

    def seen(p):
        def search(_, s, at, end=1 << 30):
            found = p.search(s, at, end)
            looked.append((found.end() if found else min(len(s), end)) - at)
            return found

        return type("Seen", (), {"search": search})()

    monkeypatch.setattr(tx, "_TWICE", {n: seen(p) for n, p in tx._TWICE.items()})
    texts = [f"{'abcdefghijklm'[k % 13]}{k:015d}" for k in range(3000)]
    tx.merged(texts, True)
    assert sum(looked) < 9 * 60 * len(texts)


def test_places_of_windows_are_made_after_the_join(spark, folder):
    """Neither texts nor windows go through a join, sort or window; rows of a shared or null box keep their names."""
    from inkstream.plans import catalog
    from inkstream.plans.fixtures import Inputs

    for q in (catalog.segment_places, catalog.segment_names):
        plan = q(Inputs(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < min(plan.index(x) for x in ("Join", "Window") if x in plan) and "regexp_extract_all" not in plan


def odd_texts(spark, tmp_path):
    """Texts that share a box or have none; of 0, 16, 17 and 37 places, of line ends and wide characters; one of 160,000."""
    from inkstream.plans.fixtures import Inputs

    long = "".join(f"{k:07d} " for k in range(20000))
    rows = [(1, "é😀\n" * 7), (2, long), (3, "a" * 16), (4, "b" * 17), (5, "c\r\n\u2028d" * 8), (6, ""), (7, None), (None, "x" * 37), (None, "y" * 20)]
    rows += [(8, "n" * 36), (8, "m" * 18), (8, "o" * 16), (8, "k" * 25), (9, "p" * 3), (9, "q" * 29)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t/documents.parquet")
    return rows, Inputs(spark, f"{tmp_path}/t")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_segments_by_lengths(spark, tmp_path):
    """Of texts that share a box the first one with a second window counts, as in the SQL; no window is made for it."""
    import oracle
    from inkstream.plans import catalog, registry

    rows, i = odd_texts(spark, tmp_path)
    got = catalog.first_segment(i)
    duck = oracle.duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert oracle.rows_of_frame(got) == oracle.rows_of_sql(duck, registry.ORACLE["first_segment"])
    assert {x.box_idx: x.first_length for x in got.collect()} == {1: 5, 2: 20, 4: 1, 5: 20, None: 20, 8: 20, 9: 13}
    assert "regexp_extract_all" not in plan_of(got) and "Generate" not in plan_of(got)


def test_windows_cost_what_they_hold(spark, tmp_path):
    """Texts are cut after they are grouped, once, without looking for a piece's place; equal places of shared boxes in order of text."""
    from inkstream.plans import catalog

    rows, i = odd_texts(spark, tmp_path)
    want = {}
    for box, text in rows:
        want.setdefault(box, []).extend((k, text[16 * k : 16 * k + 20]) for k in range((len(text or "") + 15) // 16))
    want = {box: sorted(w) for box, w in want.items() if w}
    full, one = catalog.full_text(i), i.segments()
    assert {x.box_idx: x.text for x in full.collect()} == {box: " ".join(x for _, x in w) for box, w in want.items()}
    assert sorted((str(x.box_idx), x.sub_idx, x.text) for x in one.collect()) == sorted((str(box), *x) for box, w in want.items() for x in w)
    assert "Generate" not in plan_of(full)
    assert not [x for df in (full, one) for x in plan_of(df).splitlines() if "Filter" in x and "regexp_extract_all" in x]


def test_readings_merged_with_a_running_confidence(spark):
    """Rows end at an empty text or an index further on than the merged one's next; the confidence is halved at each merge."""
    rows = [(i, [(k // 2 + (k > 5), x, k / 10) for k, x in enumerate(p or [])]) for i, p in texts_to_merge(120)]
    df = spark.createDataFrame(rows, "i int, r array<struct<idx:int,text:string,confidence:double>>").select("i", tx.merge_readings_older("r").alias("m"))
    for i, merged in df.collect():
        want, current = [], None
        for idx, text, confidence in rows[i][1]:
            text = text or ""
            if current and idx in (current[0], current[0] + 1) and current[1] and text:
                current = (current[0], tx.merge_strategies(current[1], text), (current[2] + confidence) / 2)
            else:
                want += [current] if current else []
                current = (idx, text, confidence)
        assert [tuple(m) for m in merged] == want + ([current] if current else [])


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_tiled_components_are_those_of_whole_pictures(spark, tile):
    """Random pictures, a spiral through all tiles, and one pixel; neighbours meet across corners too."""
    r = np.random.default_rng(tile)
    points = {(1, int(y), int(x)) for y, x in r.integers(0, 40, (700, 2))} | {(2, 7, 7)}
    top, left, bottom, right = 0, 0, 30, 30
    while top < bottom and left < right:  # a line that winds inwards
        points |= {(3, top, x) for x in range(left, right + 1)} | {(3, y, right) for y in range(top, bottom + 1)}
        points |= {(3, bottom, x) for x in range(left + 1, right + 1)} | {(3, y, left + 1) for y in range(top + 2, bottom + 1)} | {(3, top + 2, left + 1)}
        top, left, bottom, right = top + 2, left + 1, bottom - 2, right - 2
    mask = spark.createDataFrame(sorted(points), "image_id int, y int, x int")
    key = lambda df: sorted(map(tuple, df.select("image_id", "y", "x", "label").collect()))
    assert key(heatmap.tiled_components(mask, tile)) == key(heatmap.components(mask))
    assert heatmap.tiled_components(mask.where("false"), tile).count() == 0


def test_roots_of_long_chains(spark):
    edges = [(0, i, i + 1) for i in range(200)] + [(1, 5, 9), (1, 9, 7), (1, 3, 3)]
    got = {(x.image_id, x.node): x.root for x in heatmap.roots(spark.createDataFrame(edges, "image_id int, a long, b long")).collect()}
    assert got == {(0, i): 0 for i in range(201)} | {(1, i): 5 for i in (5, 7, 9)}


def test_search_in_blocks(spark):
    """Blocks of a few rows against all pairs; ties by id; what has no direction is left out."""
    r = np.random.default_rng(2)
    vectors = [(i, r.integers(-2, 3, 3).astype(float).tolist()) for i in range(120)]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 0.0]), (203, [float("nan"), 1.0, 0.0]), (5, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(vectors + odd, "vec_id int, embedding array<double>")
    got = rank.top_k(v.where("vec_id % 10 = 0 or vec_id > 199").withColumnRenamed("vec_id", "query_id"), v, 4, query_block=5, vector_block=7).collect()
    unit = [(i, np.array(x) / np.linalg.norm(x)) for i, x in [*vectors, odd[-1]] if np.linalg.norm(x) > 0]
    for q, x in [(i, x) for i, x in unit if i % 10 == 0]:
        mine = sorted((a for a in got if a.query_id == q), key=lambda a: a.rank)
        best = sorted(((round(-float(x @ y), 9), i) for i, y in unit))[:4]
        assert [round(-a.score, 9) for a in mine] == [s for s, _ in best]
        assert all(round(float(x @ dict(unit)[a.vec_id]), 9) == round(a.score, 9) or a.vec_id == 5 for a in mine)
    assert {a.query_id for a in got} == {i for i, _ in unit if i % 10 == 0}
    assert rank.top_k(v.where("false").withColumnRenamed("vec_id", "query_id"), v, 4).count() == 0


def test_stage_log(spark, tmp_path):
    """Two runs of two stages, one of which fails."""
    from inkstream.operators import timing

    for run in ("a", "b"):
        log = timing.StageLog(spark, run, f"{tmp_path}/log")
        with log.stage("detect") as s:
            s.watch(spark.range(10)).write.format("noop").mode("overwrite").save()
        try:
            with log.stage("read") as s:
                if run == "b":
                    raise RuntimeError("no model")
                s.watch(spark.range(3)).write.format("noop").mode("overwrite").save()
        except RuntimeError:
            pass
        log.close()
    rows = {(x.run, x.stage): x for x in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert (rows["a", "detect"].rows, rows["a", "read"].rows, rows["b", "detect"].rows, rows["b", "read"].rows) == (10, 3, 10, None)
    assert rows["a", None].ms == rows["a", "detect"].ms + rows["a", "read"].ms
    averages = {x.stage: x for x in timing.session_averages(spark.read.parquet(f"{tmp_path}/log")).collect()}
    assert averages["detect"].runs == 2 and averages["detect"].rows == 20 and averages[None].mean_ms == (rows["a", None].ms + rows["b", None].ms) / 2
