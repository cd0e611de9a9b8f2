"""Files to blocks in one call, pixel measures against plain loops, streaming detectors against the batch forms."""

import json
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import sinks
from framewright.engine import detect
from framewright.operators import events as E
from framewright.operators import model as M
from framewright.operators import pixels as P
from framewright.operators import speaker as S
from framewright.options import Options
from framewright.sources import audio, features
from framewright.sources import frames as V
from framewright.streaming import detect as D

W, H, FPS = 32, 24, 5


def clip(rng, seconds, absent, black=()):
    """A clip with a square logo that is absent for some seconds, and black for others."""
    frames = []
    for k in range(seconds * FPS):
        t = k / FPS
        f = rng.integers(60, 70, (H, W, 3)).astype(np.uint8)
        if not any(a <= t < b for a, b in absent):
            f[4:10, 20:28] = 250
        if any(a <= t < b for a, b in black):
            f[:] = 0
        frames.append(f)
    return np.stack(frames)


CELLS = np.array([(x, y) for x in range(19, 29) for y in range(3, 11) if x in (19, 20, 27, 28) or y in (3, 4, 9, 10)])


def test_files_to_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    spark.dataSource.register(V.Rgb24)
    clips = {"a": clip(rng, 120, [(40, 80)], [(41, 41.4), (79, 79.6)]), "b": clip(rng, 60, [])}
    parts = []
    for name, f in clips.items():
        (tmp_path / name).write_bytes(f.tobytes())
        parts.append(spark.read.format("rgb24").options(path=f"{tmp_path}/{name}", width=W, height=H, fps=FPS, framesPerPartition=64).load())
    silences = spark.createDataFrame([("a", 41.0, 41.5)], "rid string, start_s double, end_s double")
    o = Options(fps=FPS, min_block_s=10, min_show_segment_s=5, min_absent_open_s=2, refine_window_s=5, logo_smooth_s=1, nn_weight=0, logo_threshold=0.4, max_ad_gap_s=2, logo_cross_refine_s=0)
    found = detect(parts[0].unionByName(parts[1]), W, H, o, CELLS, silences=silences, bumpers_end=spark.createDataFrame([([-1 % 2**32] * (W * H // 32),)], "mask array<bigint>"), bar_rows=3)
    blocks = [(r.rid, round(r.start_s, 3), round(r.end_s, 3)) for r in found.blocks.collect()]
    # The cuts into and out of black vote with it; of the cluster the one nearest to the rough edge is taken.
    assert blocks == [("a", 41.0, 79.6)]
    runs = sorted((r.start_s, r.end_s) for r in found.events.where("kind = 'black'").collect())
    assert np.allclose(runs, [(41.0, 41.4), (79.0, 79.6)])
    assert found.events.where("kind = 'scene' AND rid = 'a'").count() >= 4
    rec = spark.createDataFrame([("a", float(FPS), W, H, 600, 2.0), ("b", float(FPS), W, H, 300, 1.5)], "rid string, fps double, width int, height int, frame_count bigint, elapsed_s double")
    summaries = {r.rid: json.loads(r.value) for r in sinks.summaries(rec, found.blocks).collect()}
    assert summaries["b"]["blocks"] == [] and summaries["b"]["stats"] == {"elapsed_s": 1.5, "fps_proc": 200.0}
    assert np.allclose(summaries["a"]["blocks"], [[41.0, 79.6]])


def table(spark, stack, rid=0):
    return spark.createDataFrame([(rid, i, f.tobytes()) for i, f in enumerate(stack)], "rid bigint, frame bigint, pixels binary")


def test_measures_against_loops(spark):
    rng = np.random.default_rng(2)
    stack = rng.integers(0, 256, (4, H, W, 3)).astype(np.uint8)
    stack[1, :5], stack[1, -5:] = 3, 9
    stack[2] = 0
    m = P.measured(table(spark, stack).repartition(2), W, H, P.black(), P.histogram(), P.letterbox(4), P.white(), P.logo(CELLS)).orderBy("frame").collect()
    for f, r in zip(stack.astype(int), m, strict=True):
        v = (77 * f[..., 0] + 150 * f[..., 1] + 29 * f[..., 2]) >> 8
        assert r.black == (np.mean(v <= 26) >= 0.98)
        hist = np.zeros(512, int)
        for px in f.reshape(-1, 3):
            hist[(px[0] >> 5) * 64 + (px[1] >> 5) * 8 + (px[2] >> 5)] += 1
        assert r.histogram == hist.tolist()
        assert r.framed == all(np.sum(bar <= 16) >= int(bar.size * 0.95) for bar in (v[:4], v[-4:]))
        bits = (v > 80).ravel()
        assert r.words == [sum(1 << k for k in range(32) if 32 * i + k < len(bits) and bits[32 * i + k]) for i in range(-(-len(bits) // 32))]
        gx, gy = P.gradients(v)
        for y in range(1, H - 1):
            for x in range(1, W - 1):
                n = v[y - 1 : y + 2, x - 1 : x + 2]
                assert gx[y - 1, x - 1] == (n[:, 2] * [1, 2, 1]).sum() - (n[:, 0] * [1, 2, 1]).sum() and gy[y - 1, x - 1] == (n[2] * [1, 2, 1]).sum() - (n[0] * [1, 2, 1]).sum()
        assert r.confidence == pytest.approx(np.mean([abs(gx[y - 1, x - 1]) + abs(gy[y - 1, x - 1]) > 80 for x, y in CELLS]))
    counts = {(r.x, r.y): (r.h, r.v) for r in P.edge_counts(table(spark, stack).repartition(3), W, H).collect()}
    assert len(counts) == (W - 2) * (H - 2)
    whole = [P.gradients(P.luma_of(f)) for f in stack]
    assert counts[5, 7] == (sum(abs(gx[6, 4]) > 80 for gx, _ in whole), sum(abs(gy[6, 4]) > 80 for _, gy in whole))


def test_broadcast_size_clip_takes_seconds(spark, tmp_path):
    """500 frames of 720 x 576: one pass, nothing shuffled but numbers."""
    rng = np.random.default_rng(3)
    one = [rng.integers(0, 256, (576, 720, 3)).astype(np.uint8).tobytes() for _ in range(5)]
    with open(tmp_path / "v.rgb", "wb") as f:
        for k in range(500):
            f.write(one[k % 5])
    spark.dataSource.register(V.Rgb24)
    frames = spark.read.format("rgb24").options(path=f"{tmp_path}/v.rgb", width=720, height=576, framesPerPartition=32).load()
    df = P.measured(frames, 720, 576, P.black(), P.histogram(), P.letterbox(), P.logo(CELLS), P.white())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    began = time.time()
    assert df.count() == 500 and df.where("size(words) = 12960").count() == 500
    assert time.time() - began < 60


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_png(spark, tmp_path, colour):
    rng = np.random.default_rng(4)
    h, w, n = 6, 5, V.SAMPLES[colour]
    px = rng.integers(0, 4 if colour == 3 else 256, (h, w, n)).astype(int)
    rows = b""
    for y in range(h):
        how = y % 5
        rows += bytes([how])
        for x in range(w):
            a = px[y, x - 1] if x else np.zeros(n, int)
            b = px[y - 1, x] if y else np.zeros(n, int)
            c = px[y - 1, x - 1] if x and y else np.zeros(n, int)
            for k in range(n):
                p = int(a[k] + b[k] - c[k])
                near = min((abs(p - int(v)), i, int(v)) for i, v in enumerate((a[k], b[k], c[k])))[2]
                rows += bytes([(int(px[y, x, k]) - (0, int(a[k]), int(b[k]), int(a[k] + b[k]) // 2, near)[how]) % 256])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    palette = rng.integers(0, 256, 12).astype(np.uint8).tobytes()
    packed = zlib.compress(rows)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if colour == 3 else b"") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")
    if colour == 3:
        want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[px[..., 0]]
    else:
        want = np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]
        want = want * px[..., -1:] // 255 if colour in (4, 6) else want
    assert (V.decode_png(png) == want).all()
    (tmp_path / "t.png").write_bytes(png)
    r = V.bumper_templates(spark, f"file://{tmp_path}/t.png", 10, 12).first()
    big = np.array([[want[y * h // 12, x * w // 10] for x in range(10)] for y in range(12)]).astype(int)
    bits = ((77 * big[..., 0] + 150 * big[..., 1] + 29 * big[..., 2]) >> 8 > 80).ravel()
    assert r.white == bits.sum() and sum(int(m).bit_count() for m in r.mask) == bits.sum()
    with pytest.raises(ValueError):
        V.decode_png(b"GIF89a")


def test_network_input(spark):
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (H, W, 3)).astype(np.uint8)
    r = V.preprocessed(table(spark, rgb[None]), W, H, 16).first()
    got = np.frombuffer(r.input, "<f4").reshape(3, 16, 16)
    for ty, tx in ((0, 0), (3, 7), (15, 15), (9, 1)):
        sy, sx = ty * H / 16, tx * W / 16
        y, x = int(sy), int(sx)
        fy, fx = sy - y, sx - x
        y1, x1 = min(y + 1, H - 1), min(x + 1, W - 1)
        mixed = (1 - fx) * (1 - fy) * rgb[y, x] + fx * (1 - fy) * rgb[y, x1] + (1 - fx) * fy * rgb[y1, x] + fx * fy * rgb[y1, x1]
        assert got[:, ty, tx] == pytest.approx((mixed / 255 - V.MEAN) / V.DEVIATION, abs=1e-4)
    sizes = []

    def encoder():
        return lambda batch: [[float(len(batch)), float(len(b))] for b in batch]

    out = V.encoded(table(spark, np.repeat(rgb[None], 19, axis=0)).coalesce(1), encoder, "rid bigint, frame bigint, features array<double>", 8).orderBy("frame").collect()
    sizes = [r.features[0] for r in out]
    assert sizes == [8.0] * 16 + [3.0] * 3 and all(r.features[1] == 3 * W * H for r in out)


def test_heads_are_read_as_weights(spark, tmp_path):
    (tmp_path / "head.1.bin").write_bytes(V.write_head([0.5] * 1280, -1.0, w_logo=0.25, w_channels=[1, 2, 3, 4, 5, 6], w_rms=0.75))
    r = V.heads(spark, f"file://{tmp_path}").first()
    assert (len(r.w), r.w_logo, r.w_channels, r.w_rms, r.bias) == (1280, 0.25, [1, 2, 3, 4, 5, 6], 0.75, -1.0)


def test_sound(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, 3000), np.zeros(3000), rng.normal(0, 0.1, 2345)]).astype("<f4")
    (tmp_path / "a.f32").write_bytes(x.tobytes() + b"\x00")
    spark.dataSource.register(audio.Pcm)
    chunks = spark.read.format("pcm_f32").options(path=f"{tmp_path}/a.f32", chunk=800, chunksPerPartition=3).load()
    assert chunks.agg(F.sum(F.octet_length("samples"))).first()[0] == 4 * len(x)
    frames = S.voice_activity(chunks, 400, 0.005)
    got = [r.speech for r in frames.orderBy("frame").collect()]
    whole = x[: len(x) // 400 * 400].reshape(-1, 400).astype(float)
    assert got == [*(np.sqrt((whole**2).mean(axis=1)) > 0.005).tolist(), False]
    mask = np.repeat(got, 400)
    windows = {r.w: r.has_speech for r in S.speaking_windows(frames, 1600, 1000, 400).collect()}
    assert windows == {w: bool(mask[w * 1000 : w * 1000 + 1600].mean() >= 0.5) for w in range((len(mask) - 1600) // 1000 + 1)}


def test_covariance(spark):
    x = np.random.default_rng(7).normal(size=(200, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<double>").repartition(3)
    cov, n = S.covariance(df)
    assert n == 200 and cov == pytest.approx(np.cov(x.T))


def test_calibration_and_release(spark, tmp_path):
    rng = np.random.default_rng(8)
    z = rng.normal(0, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z + 0.3)))
    df = spark.createDataFrame([(i % 7, float(a), int(b)) for i, (a, b) in enumerate(zip(z, y))], "rid bigint, logit double, label int")
    c = M.calibration(df).first().asDict()
    a = b = 0.0
    for _ in range(50):  # Newton's method on the same regression
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((p - y) * z).sum(), (p - y).sum()])
        h = np.array([[(p * (1 - p) * z * z).sum(), (p * (1 - p) * z).sum()], [(p * (1 - p) * z).sum(), (p * (1 - p)).sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert (c["a"], c["b"]) == pytest.approx((a, b), abs=1e-3) and c["n_frames"] == 4000 and c["n_recs"] == 7
    assert c["brier_calibrated"] == pytest.approx(((1 / (1 + np.exp(-(a * z + b))) - y) ** 2).mean(), abs=1e-5) and c["improvement"] > 0
    d = f"file://{tmp_path}"
    assert sinks.release_head(spark, b"one", f"{d}/head.bin", f"{d}/old", "20240101T000000", True, c, ["u1", "u2"]) == "head.20240101T000000.bin"
    assert sinks.release_head(spark, b"two", f"{d}/head.bin", f"{d}/old", "20240102T000000", False) == "head.20240102T000000.bin"
    assert (tmp_path / "head.bin").read_bytes() == b"one" and (tmp_path / "old/head.20240102T000000.bin").read_bytes() == b"two"
    assert json.loads((tmp_path / "head.calibration.json").read_text())["method"] == "platt" and json.loads((tmp_path / "head.test-set.json").read_text())["n"] == 2


def test_feature_cache(spark, tmp_path):
    path, asked = f"file://{tmp_path}/cache", []

    def compute(missing):
        asked.append(sorted((r.uuid, r.source_mtime) for r in missing.collect()))
        return missing.withColumn("features", F.array(F.col("source_mtime").cast("double")))

    rec = lambda *rows: spark.createDataFrame(rows, "uuid string, source_mtime bigint")
    for rows, extras in (([("a", 1), ("b", 1)], ()), ([("a", 1), ("b", 2)], ()), ([("a", 1)], ("audio", "logo")), ([("a", 1), ("b", 1)], ())):
        out = features.read_through(rec(*rows), path, "features array<double>", compute, 1.0, *extras)
        assert sorted((r.uuid, r.features[0]) for r in out.collect()) == [(u, float(m)) for u, m in rows]
    assert asked == [[("a", 1), ("b", 1)], [("b", 2)], [("a", 1)], []]
    assert features.feature_set("audio", "logo") == "-l2-a1"
    with pytest.raises(ValueError):
        features.feature_set("smell")


def streamed(spark, path, rows, schema, build, name):
    """The rows as a stream of several files, in order."""
    df = spark.createDataFrame(rows, schema)
    step = max(1, -(-max(r[1] for r in rows) // 3))
    for k in range(4):
        df.where(f"idx >= {k * step} AND idx < {(k + 1) * step}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(stream).writeStream.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_streaming_detectors_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for rid in range(6):
        flags, value = [], bool(rid % 2)
        while len(flags) < 90:
            flags += [value] * int(rng.integers(1, 14))
            value = not value
        rows += [(rid, i, x, i == 89) for i, x in enumerate(flags[:90])]
    kinds = "rid bigint, idx bigint, {} boolean, last boolean"
    key = lambda r: tuple(r)
    got = streamed(spark, f"{tmp_path}/b", rows, kinds.format("black"), lambda s: D.streamed_black_runs(s, 25.0, 0.1), "black_runs")
    want = E.black_runs(spark.createDataFrame(rows, kinds.format("black")), 25.0, 0.1).collect()
    assert np.allclose(sorted(map(key, got)), sorted(map(key, want))) and got
    got = streamed(spark, f"{tmp_path}/l", rows, kinds.format("framed"), lambda s: D.streamed_letterbox(s, 12.0), "letterbox")
    want = E.letterbox_transitions(spark.createDataFrame(rows, kinds.format("framed")), 12.0).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and got
    hist = [(rid, i, rng.integers(0, 3, 8).tolist() if i % 10 else [9] * 8, i == 49) for rid in range(3) for i in range(50) if i != 20]
    got = streamed(spark, f"{tmp_path}/s", hist, "rid bigint, idx bigint, histogram array<int>, last boolean", lambda s: D.streamed_scene_cuts(s, 25.0, 0.2), "cuts")
    batch = spark.createDataFrame(hist, "rid bigint, frame bigint, histogram array<int>, last boolean")
    want = E.scene_cuts(P.frame_distances(batch).withColumnRenamed("frame", "idx"), 25.0, 0.2).collect()
    assert [r[:3] for r in sorted(map(key, got))] == [r[:3] for r in sorted(map(key, want))] and got
    assert [r[3] for r in sorted(map(key, got))] == pytest.approx([r[3] for r in sorted(map(key, want))])


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}.{ms}00", float(s)) for s in range(20) for ms in range(4)]
    df = spark.createDataFrame(rows, "rid bigint, t string, logo double").select("rid", F.to_timestamp("t").alias("ts"), "logo", F.col("logo").alias("x"))
    df.coalesce(1).write.parquet(f"{tmp_path}/w")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/w")
    for name, build in (("seconds", D.second_means), ("speech", D.speech_windows)):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.logo for r in spark.table("seconds").collect()) == [float(s) for s in range(20)]
    assert spark.table("speech").count() == 21 and max(r.rms for r in spark.table("speech").collect()) == 19.0


def test_a_new_head_is_taken_up(spark, tmp_path):
    heads, rows = tmp_path / "heads", f"{tmp_path}/rows"
    heads.mkdir()
    (heads / "head.1.bin").write_bytes(V.write_head([0.0] * 1280, 1.0))
    spark.range(3).coalesce(1).write.parquet(rows)
    seen = []
    stream = spark.readStream.schema("id bigint").parquet(rows)
    q = D.with_current_head(stream, f"file://{heads}", lambda batch, head, n: seen.append((batch.count(), head["bias"]))).start()
    q.processAllAvailable()
    (heads / "head.2.bin").write_bytes(V.write_head([0.0] * 1280, 2.0))
    spark.range(4).coalesce(1).write.mode("append").parquet(rows)
    q.processAllAvailable()
    q.stop()
    assert seen == [(3, 1.0), (4, 2.0)]


def test_confusion_text(spark):
    rows = [("news", 2, 100, 0.91, 0.8, 0.7), (None, 3, 150, 0.9, 0.75, 0.65), ("a show", 1, 50, 1.0, 1.0, 1.0)]
    out = sinks.confusion_text(spark.createDataFrame(rows, "show string, n_recs bigint, frames bigint, accuracy double, f1 double, iou double")).orderBy("nth").collect()
    assert [r.value.split()[0] for r in out] == ["a", "news", "OVERALL"] and out[1].value.split()[1:] == ["2", "100", "91.0%", "0.80", "0.70"]
