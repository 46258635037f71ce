import json

import numpy as np
import pytest
from images import png
from pyspark.sql import functions as F

from facetwatch.functions import times
from facetwatch.operators import extract, geometry
from facetwatch.plans import workloads
from facetwatch.schemas import FEATURES, ROW_SIZES
from facetwatch.sources import annotations, calibration, images, store
from facetwatch.streaming import scoring


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Twenty-four frames of two facets, one file that is no image."""
    top, rng = tmp_path_factory.mktemp("archive"), np.random.default_rng(3)
    for t in range(24):
        a = np.clip(rng.normal(120, 20, (60, 80, 3)), 0, 255).astype(np.uint8)
        if t == 20:
            a[5:25, 5:35] = 255
        png(top / f"2025/10/05/IRCamM1T20251005_{6 + t // 6:02d}{t % 6}000M.png", a)
    (top / "2025/10/05/broken.png").write_bytes(b"no image")
    polygons = {"id_000": [[5, 5], [34, 5], [34, 24], [5, 24], [5, 5]], "id_001": [[40, 30], [75, 32], [70, 55], [42, 50], [40, 30]]}
    (top / "calibration.json").write_text(json.dumps({"calib_img": "x.png", "mirror_ids": polygons}))
    (top / "marks.json").write_text(json.dumps([{"file": "IRCamM1T20251005_092000M.png", "marked_mirrors": [0]}, {"file": "missing.png", "marked_mirrors": [1]}]))
    return top


def decoded(frames):
    """Images as arrays of B, G, R."""
    return {r.frame_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in frames.where("height > 0").collect()}


def gray(img):
    b, g, r = (img[..., k].astype(float) for k in range(3))
    return np.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).astype(int)


def test_pixels_of_facets(spark, archive):
    frames = images.read_frames(spark, str(archive / "2025"), "*.png").limit(3).cache()
    facets = calibration.read_calibration(spark, str(archive / "calibration.json"))
    imgs = decoded(frames)
    inside, whole = {}, {}
    for r in extract.facet_pixels(frames, facets).collect():
        inside.setdefault((r.frame_id, r.mirror_id), {})[r.y, r.x] = (r.v, r.r, r.g, r.b)
    for r in extract.crops(frames, facets).collect():
        whole.setdefault((r.frame_id, r.mirror_id), {})[r.y, r.x] = (r.v, r.r, r.g, r.b)
    assert len(inside) == len(whole) == 6
    for (f, m), px in inside.items():
        x0, y0, h, w = (5, 5, 20, 30) if m == 0 else (40, 30, 26, 36)
        g = gray(imgs[f])
        assert all(px[y, x] == (g[y0 + y, x0 + x], *map(int, imgs[f][y0 + y, x0 + x, ::-1])) for y, x in px)
        assert set(whole[f, m]) == {(y, x) for y in range(h) for x in range(w)} and (m or len(px) == h * w)
        assert all(v == px.get(at, (0, 0, 0, 0)) for at, v in whole[f, m].items())


def test_facets_off_the_frame_are_dark_there(spark, archive):
    frames = images.read_frames(spark, str(archive / "2025"), "*.png").limit(1)
    facets = spark.createDataFrame([(3, [{"x": -4, "y": -2}, {"x": 5, "y": -2}, {"x": 5, "y": 6}, {"x": -4, "y": 6}])], "mirror_id int, points array<struct<x: int, y: int>>")
    rows = {(r.y, r.x): r.v for r in extract.crops(frames, facets).collect()}
    assert len(rows) == 90 and all(rows[y, x] == 0 for y, x in rows if y < 2 or x < 4) and sum(v > 0 for v in rows.values()) > 30


def test_features_by_family(spark, archive):
    frames = images.read_frames(spark, str(archive / "2025"), "*.png").limit(3).cache()
    facets = calibration.read_calibration(spark, str(archive / "calibration.json"))
    got = extract.features(frames, facets, ["photometric", "gradient"]).collect()
    assert len(got) == 6
    imgs = decoded(frames)
    for r in got:
        if r.mirror_id == 0:
            v = gray(imgs[r.frame_id])[5:25, 5:35]
            assert r.median == np.median(v) and r.cov == pytest.approx(v.std() / v.mean(), abs=1e-6) and r.sat_frac == (v >= 250).mean()
    with pytest.raises(KeyError):
        extract.features(frames, facets, ["nothing"])
    with pytest.raises(ValueError):
        extract.features(frames, facets, ["edges", "edges"])


def test_stack_of_images(spark, archive):
    frames = images.read_frames(spark, str(archive / "2025"), "*.png")
    stack = np.stack([gray(a) for a in decoded(frames).values()])
    rows = extract.stack_images(frames).collect()
    assert len(rows) == 60 * 80
    for r in rows:
        own = stack[:, r.y, r.x]
        assert r.n == len(stack) and r.median == np.median(own) and r.mean == pytest.approx(own.mean())


def test_read_frames(spark, archive):
    frames = images.read_frames(spark, str(archive), "*.png")
    rows = frames.select("frame_id", F.date_format("ts", "HH:mm").alias("at")).orderBy("frame_id").collect()
    assert len(rows) == 24 and rows[0].at == "06:00" and rows[-1].at == "09:50"
    assert [r.frame_id for r in images.unreadable(spark, str(archive), "*.png").collect()] == ["broken.png"]
    assert images.read_frames(spark, str(archive), "*.png", max_images=3).count() == 3


def test_pixel_stage(spark, archive, tmp_path):
    frames, facets = images.read_frames(spark, str(archive), "*.png"), calibration.read_calibration(spark, str(archive / "calibration.json"))
    obs = extract.extract(frames, facets).cache()
    assert obs.columns == ["frame_id", "ts", "mirror_id", "valid", *FEATURES] and obs.count() == 48 and obs.where("valid").count() == 48
    store.write_observations(obs, str(tmp_path / "obs"), meta={"config": "test"})
    back, meta = store.read_observations(spark, str(tmp_path / "obs"))
    assert back.count() == 48 and (meta.first().n_images, meta.first().n_mirrors) == (24, 2)
    _, base, _ = workloads.build_baseline(frames.where("hour(ts) < 7"), facets)
    assert base.count() == 2 * len(FEATURES)
    some = ["glcm_contrast", "lbp_entropy", "sobel_mean"]
    from facetwatch.operators import baseline, score

    vb = baseline.vector_baseline(back.where("hour(ts) < 9"), "mirror_id", some)
    marks = annotations.read_annotations(spark, str(archive / "marks.json"))
    scored = score.mahalanobis(back, vb, "mirror_id", some)
    assert scored.orderBy(F.desc("mahalanobis")).first().mirror_id == 0
    _, _, total = workloads.evaluate(back, vb, marks, some, n_std=0.5)
    assert (total.first().tp, total.first().fp, total.first().fn) == (1, 0, 0)
    out = workloads.track(back, order=["ts", "frame_id"], features=some, lower=["sobel_mean"])
    assert out["ranks"].count() == 48


def test_failed_frames_give_nulls(spark, archive):
    frames = images.read_frames(spark, str(archive), "*.png", drop_invalid=False)
    facets = calibration.read_calibration(spark, str(archive / "calibration.json"))
    obs = extract.extract(frames, facets, ["photometric"])
    bad = extract.failures(obs).where("frame_id = 'broken.png'").first()
    assert (bad.n_valid, bad.n_failed) == (0, 2)


def test_masked_features(spark, archive):
    frames = images.read_frames(spark, str(archive), "*.png", max_images=3)
    facets = calibration.read_calibration(spark, str(archive / "calibration.json"))
    masks = extract.facet_masks(frames, facets)
    assert masks.where("mirror_id = 0").count() == 600 and 400 < masks.where("mirror_id = 1").count() < 26 * 36
    rows = extract.masked_features(frames, facets, masks).collect()
    img = decoded(frames)
    assert len(rows) == 6
    for r in rows:
        assert r.glcm_contrast is not None and r.lbp_entropy > 1 and 0 < r.edge_density <= 1
        if r.mirror_id == 0:
            assert r.median == np.median(gray(img[r.frame_id])[5:25, 5:35])


def test_crops_stacks_measures(spark, archive, tmp_path):
    frames = images.read_frames(spark, str(archive), "*.png", max_images=6)
    facets = calibration.read_calibration(spark, str(archive / "calibration.json"))
    cut = extract.crops(frames, facets)
    store.write_crops(cut.drop("patch"), str(tmp_path / "crops"))
    back = spark.read.parquet(str(tmp_path / "crops"))
    assert {r.mirror_id: r.n for r in back.groupBy("mirror_id").agg(F.count("*").alias("n")).collect()} == {0: 6 * 600, 1: 6 * 26 * 36}
    entries = back.select("mirror_id", "frame_id", "ts").distinct()
    info = {r.mirror_id: r.n_observations for r in store.crop_info(entries).collect()}
    assert info == {0: 6, 1: 6, None: 12} and store.crop_manifest(entries).where("entry = 5").count() == 2
    assert {len(r.pixels) for r in extract.crop_arrays(cut).collect()} == {288}
    for kind, column in (("quality", "sharpness"), ("details", "entropy"), ("sky", "blue_ratio"), ("sun", "sun_score")):
        rows = extract.frame_measures(frames, kind).collect()
        assert len(rows) == 6 and all(r[column] is not None and r.ts for r in rows)
    window = extract.crop_window(frames, 3, 4, 10, 12)
    assert window.count() == 6 * 120 and window.where("frame_id like '%060000M.png' and y = 0 and x = 0").first().v == gray(decoded(frames)["IRCamM1T20251005_060000M.png"])[3, 4]
    assert workloads.select_frames(images.read_frames(spark, str(archive), "*.png"), "good", (6, 8)).count() <= 12


def test_calibration_round_trip(spark, archive, tmp_path):
    facets = calibration.read_calibration(spark, str(archive / "calibration.json"))
    calibration.write_calibration(facets, "x.png", str(tmp_path / "out"))
    again = calibration.read_calibration(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, facets.collect()))
    with pytest.raises(Exception, match="id_007"):
        calibration.require_facets(facets, spark.createDataFrame([(7,)], "mirror_id int")).collect()


def test_grid_to_facets(spark, tmp_path):
    (tmp_path / "rows.txt").write_text("row, grid_id_start, grid_id_stop\n1, 0, 1\n2, 17, 18\n")
    ranges = calibration.read_ranges(spark, str(tmp_path / "rows.txt"))
    flat = spark.createDataFrame([([[10 * (k % 18), 10 * (k // 18)] for k in range(324)],)], "p array<array<int>>")
    points = geometry.grid_points(flat, "p")
    made = {r.mirror_id: [(p.x, p.y) for p in r.points] for r in calibration.make_calibration(ranges, points).collect()}
    assert len(made) == 4 and made[2] == [(0, 10), (10, 10), (10, 20), (0, 20), (0, 10)]
    assert geometry.grid_cells(points).count() == 289


def test_dish_geometry(spark):
    rows = geometry.row_table(spark)
    where, edges = geometry.hex_positions(rows), geometry.hex_edges(rows, touching=True)
    assert where.count() == 249 == sum(ROW_SIZES)
    counts = geometry.neighbour_count(edges)
    assert counts.agg(F.max("n_neighbours")).first()[0] <= 6 and edges.count() == 2 * geometry.undirected(edges).count()
    assert (geometry.undirected(edges).count(), geometry.undirected(geometry.hex_edges(rows)).count()) == (688, 816)


def test_annotations(spark, archive, tmp_path):
    marks = annotations.read_annotations(spark, str(archive / "marks.json"))
    annotations.write_annotations(marks, str(tmp_path / "marks"))
    assert spark.read.json(str(tmp_path / "marks")).count() == 2
    text = spark.createDataFrame([("f", "3, 1,,x, 2"), ("g", None)], "file string, marks string")
    assert sorted(r.mirror_id for r in annotations.from_text(text, "file", "marks").collect()) == [1, 2, 3]


def test_times(spark):
    names = [("a/IRCamM1T20251005_075000M.jpg", "2025-10-05 07:50:00"), ("image_2024-05-06_1000.jpg", "2024-05-06 10:00:00"), ("other.jpg", None)]
    for r in spark.createDataFrame(names, "n string, want string").select("want", F.date_format(times.frame_time("n"), "yyyy-MM-dd HH:mm:ss").alias("got")).collect():
        assert r.got == r.want
    r = spark.range(1).select(times.mirror_key(F.lit(7)).alias("k"), times.mirror_of(F.lit("id_248")).alias("m")).first()
    assert (r.k, r.m) == ("id_007", 248)


def test_streaming_scores(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{t}", 1, float(t % 5)) for t in range(40)] + [("bad", 1, 99.0)], "frame string, unit int, a double")
    rows.write.parquet(str(tmp_path / "in"))
    from facetwatch.operators import baseline

    base = baseline.robust_baseline(rows, "unit", ["a"])
    out = scoring.outlier_stream(scoring.observation_stream(spark, str(tmp_path / "in"), rows.schema), base, "frame", "unit", ["a"])
    scoring.append_to(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.frame for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["bad"]
