"""Sources and sinks: written files come back."""

import base64
import gzip
import json
import random
import re
import wave
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import fractions
from cadenza.sources import arrays, audio, canvas, files, progress


def tone(path, seconds, rate=1000, channels=2):
    x = (np.arange(int(seconds * rate)) % 100 * 100).astype("<i2")
    with wave.open(str(path), "w") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat(x, channels).tobytes())
    return x / 32768


def test_sound_windows(spark, tmp_path):
    x = tone(tmp_path / "a.wav", 2.5)
    audio.register(spark)
    got = spark.read.format("pcm").option("window", 1).option("overlap", 0.25).load(str(tmp_path / "a.wav")).orderBy("window").collect()
    assert [r.start_s for r in got] == [0.0, 0.75, 1.5]
    assert np.allclose(got[1].samples, x[750:1750], atol=1e-6) and len(got[2].samples) == 1000
    assert audio.windows(0, 1000, 1, 0) == []


def written(path, x, width, rate=1000):
    """A sound file of integer samples."""
    whole = (np.asarray(x, "int64") + (128 if width == 1 else 0)).astype("<i8").reshape(-1, 1)
    with wave.open(str(path), "w") as f:
        f.setnchannels(1)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(whole.view("u1").reshape(-1, 8)[:, :width].tobytes())


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_all_sample_widths(spark, tmp_path, width):
    top = 2 ** (8 * width - 1)
    x = np.array([0, 1, -1, top - 1, -top, top // 3, -top // 5])
    written(tmp_path / "a.wav", x, width)
    audio.register(spark)
    got = spark.read.format("pcm").load(str(tmp_path / "a.wav")).first()
    assert np.allclose(got.samples, x / top, atol=1e-7)
    frames = spark.createDataFrame([("b", i, float(v) / top) for i, v in enumerate(x)], "name string, i int, s double")
    back = audio.write_pcm(frames, "name", "i", ["s"], str(tmp_path / "out"), 1000, width).first()
    assert back.frames == len(x) and np.allclose(spark.read.format("pcm").load(back.path).first().samples, x / top, atol=1e-7)


def direct(x, native, rate):
    """Each resampled value by its formula: a windowed sinc over the whole sound, divided by the sum of its weights."""
    cut = min(1, rate / native) * audio.ROLL_OFF
    half = int(np.ceil(audio.CROSSINGS / cut))
    out = []
    for m in range(-(-len(x) * rate // native)):
        at = m * native / rate
        n = np.arange(int(np.floor(at)) - half, int(np.floor(at)) + half + 2)
        w = np.sinc(cut * (at - n)) * np.where(np.abs(at - n) < half, 0.5 + 0.5 * np.cos(np.pi * (at - n) / half), 0)
        w /= w.sum()
        ok = (n >= 0) & (n < len(x))
        out.append((w[ok] * x[n[ok]]).sum())
    return np.array(out)


@pytest.mark.parametrize(("native", "rate"), [(1000, 735), (1000, 500), (441, 1000), (997, 640)])
def test_windows_of_another_rate_have_no_seam(spark, tmp_path, native, rate):
    rng = np.random.default_rng(2)
    x = rng.integers(-30_000, 30_000, 2300)
    written(tmp_path / "a.wav", x, 2, native)
    audio.register(spark)
    read = spark.read.format("pcm").option("rate", rate).option("window", 0.3).option("overlap", 0.1)
    got = read.load(str(tmp_path / "a.wav")).orderBy("window").collect()
    want = direct(x / 32768, native, rate)
    size, hop = round(0.3 * rate), round(0.2 * rate)
    assert len(got) > 5 and all(r.rate == rate for r in got)
    for r in got:
        assert np.allclose(r.samples, want[r.window * hop : r.window * hop + size], atol=1e-6)
        assert r.start_s == r.window * hop / rate
    assert got[-1].window * hop + len(got[-1].samples) == len(want)
    one = spark.read.format("pcm").option("rate", rate).option("offset", 0.5).option("duration", 0.25).load(str(tmp_path / "a.wav")).collect()
    assert len(one) == 1 and np.allclose(one[0].samples, want[int(0.5 * rate) : int(0.5 * rate) + int(0.25 * rate)], atol=1e-6)
    late = spark.read.format("pcm").option("rate", rate).option("offset", 99).load(str(tmp_path / "a.wav")).collect()
    assert [len(r.samples) for r in late] == [1]  # beyond the end the last sample is read


def test_a_tone_keeps_its_pitch_and_what_the_rate_cant_hold_goes():
    t = np.arange(20_000) / 44_100
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 15_000 * t)
    y = audio.resampled(low + high, 0, 44_100, 22_050, 0, 10_000)
    assert np.abs(y[200:-200] - np.sin(2 * np.pi * 1000 * np.arange(10_000) / 22_050)[200:-200]).max() < 0.01


def test_array_ranges_and_hashes(spark, tmp_path):
    x = np.arange(24, dtype="float32").reshape(4, 2, 3)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.array([7, -8], dtype="int16"))
    np.save(tmp_path / "c.npy", np.zeros((0, 5)))
    arrays.register(spark)
    names = ",".join(str(tmp_path / f"{n}.npy") for n in "abc")
    for rows in (1, 3, 100):
        got = spark.read.format("npy").option("rows", rows).load(names)
        found = sorted((r.path[-5], r.row, list(r["values"])) for r in got.collect())
        assert found == [("a", i, x[i].ravel().tolist()) for i in range(4)] + [("b", 0, [7.0]), ("b", 1, [-8.0])]
    np.save(tmp_path / "d.npy", np.asfortranarray(x[0]))
    with pytest.raises(Exception, match="row order"):
        spark.read.format("npy").load(str(tmp_path / "d.npy")).collect()
    import hashlib

    hashes = {r.path[-5]: r.sha256 for r in files.content_hashes(spark, str(tmp_path)).collect()}
    assert hashes["a"] == hashlib.sha256((tmp_path / "a.npy").read_bytes()).hexdigest()


def node(kind, x, y=0.0, text=None, file=None):
    return {"id": "", "type": kind, "x": x, "y": y, "text": text, "file": file}


def place(nodes, clips):
    """One canvas by plain loops."""
    anchors = []
    for n in nodes:
        m = re.search(r"@(\d{1,3}):(\d{2})(?!\d)", n["text"] or "") if n["type"] == "text" else None
        if m and int(m[2]) < 60:
            anchors.append((n["x"] or 0.0, int(m[1]) * 60.0 + int(m[2])))
    if len(anchors) < 2:
        return []
    anchors.sort(key=lambda a: a[0])

    def seconds(x):
        if x <= anchors[0][0]:
            return anchors[0][1]
        if x >= anchors[-1][0]:
            return anchors[-1][1]
        (x0, s0), (x1, s1) = next((a, b) for a, b in zip(anchors, anchors[1:], strict=False) if a[0] <= x <= b[0])
        return s0 + (x - x0) / (x1 - x0) * (s1 - s0)

    stem = lambda p: re.sub(r"(?<=.)\.[^.]+$", "", re.split(r"[/\\]", p)[-1]).lower()
    placed = []
    for pos, n in enumerate(nodes):
        name = stem(n["file"] or "")
        if n["type"] != "file" or (999 if n["y"] is None else n["y"]) >= 520 or not name:
            continue
        found = [c for c in clips if stem(c[1]) == name][-1:] or [c for c in clips if name in c[1].lower()][:1]
        if found:
            placed.append((seconds(n["x"] or 0.0), pos, found[0]))
    out, end = [], 0.0
    for at, pos, (clip, _, length) in sorted(placed, key=lambda p: p[:2]):
        start = max(at, end)
        end = start + (length or 5.0)
        out.append((pos, clip, round(start, 6), round(end, 6)))
    return out


def test_canvases_match_plain_loops(spark, tmp_path):
    rng = random.Random(6)
    clips = [(1, "/m/A.mp4", 3.0), (2, "/m/bee.mov", None), (3, "/m/a.MP4", 0.0), (4, "/other/long_name_here.mp4", 7.5), (5, "x", 1.0), (6, "/m/.hidden", 2.0)]
    names = ["A.mp4", "dir/bee.mov", "d\\a.png", "name_he", "ng_na.mp4", "x", "", None, "no such", ".hidden", "m"]
    canvases = {}
    for c in range(12):
        nodes = [node("text", float(rng.randrange(0, 60, 10)), text=rng.choice(["@0:10", "at @1:20 x", "@2:75", "@3:00", "none", "@12:345", None, "@999:59"])) for _ in range(rng.randrange(7))]
        nodes += [node("file", rng.choice([None, float(rng.randrange(-20, 90))]), rng.choice([0.0, 519.9, 520.0, None]), file=rng.choice(names)) for _ in range(15)]
        rng.shuffle(nodes)
        canvases[c] = nodes
        (tmp_path / f"{c}.canvas").write_text(json.dumps({"nodes": nodes}))
    known = spark.createDataFrame([(i, *c) for i, c in enumerate(clips)], "n int, clip int, path string, duration double")
    for rows in (1_000_000, 10):
        got = {c: [] for c in canvases}
        for r in canvas.placed_clips(canvas.nodes(spark, str(tmp_path)), known, "n", rows).orderBy("start", "pos").collect():
            got[int(re.search(r"(\d+)\.canvas", r.canvas)[1])].append((r.pos, r.clip, round(r.start, 6), round(r.end, 6)))
        assert got == {c: place(n, clips) for c, n in canvases.items()}
    assert sum(map(len, got.values())) > 20
    assert canvas.placed_clips(canvas.nodes(spark, str(tmp_path)), known.where("false"), "n").count() == 0


def test_published_tables_change_together(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = spark.range(3).toDF("x"), spark.range(1).toDF("n")
    with pytest.raises(FileNotFoundError):
        files.published(spark, path)
    assert files.publish_tables({"a": a, "b": b}, path) == 1
    old = files.published(spark, path)
    # between the writing of the new tables and the manifest a reader has both old ones
    shown = []
    write = files._manifests

    def during(*args):
        shown.append({k: v.count() for k, v in {n: spark.read.parquet(f) for n, f in files._read_manifest(spark, write(*args)[-1][1]).items()}.items()})
        return write(*args)

    files._manifests = during
    try:
        assert files.publish_tables({"a": a.where("false"), "b": b.withColumn("n", F.lit(9))}, path) == 2
    finally:
        files._manifests = write
    assert shown[0] == {"a": 3, "b": 1}
    new = files.published(spark, path)
    assert (new["a"].count(), new["b"].first().n, old["a"].count(), old["b"].first().n) == (0, 9, 3, 0)
    (tmp_path / "store" / ".claim-000000000003").write_text("")  # another writer was first
    with pytest.raises(RuntimeError):
        files.publish_tables({"a": a, "b": b}, path)
    assert files.published(spark, path)["b"].first().n == 9
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".staged")]


def test_polled_lines_survive_a_failure(spark, tmp_path):
    """A batch that fails is read again from the same bytes; lines without a line break wait; nothing comes twice."""
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.txt").write_text("".join(f"a{i}\n" for i in range(50)) + "part")
    (logs / "b.txt").write_text("long " * 100 + "\nb1\r\n")
    progress.register(spark)
    fail = [True]

    def write(batch, number):
        if fail:
            fail.pop()
            raise ValueError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        stream = spark.readStream.format("lines").option("rangeBytes", 7).load(str(logs))
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    try:
        run()
    except Exception:  # noqa: S110 - the planted failure
        pass
    (logs / "a.txt").write_text((logs / "a.txt").read_text() + "ial\nlast\n")
    run()
    run()
    rows = spark.read.schema("path string, at long, line string").parquet(f"{out}/batch=*").collect()
    assert sorted(r.line for r in rows if r.path.endswith("a.txt")) == sorted([f"a{i}" for i in range(50)] + ["partial", "last"])
    assert sorted(r.line for r in rows if r.path.endswith("b.txt")) == sorted(["long " * 100, "b1"])
    assert not fail


def test_fractions(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(-(10 ** rng.randrange(1, 18)), 10 ** rng.randrange(1, 18)), rng.randrange(1, 10 ** rng.randrange(1, 18))) for _ in range(300)]
    pairs += [(0, 5), (1, 3), (5, 1), (-7, 14), (10**17, 3), (1, 2), (3, 2), (2997, 100), (1, 0), (1, -2)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(999, None, 3), (998, 3, None)], "i int, n long, d long")
    for most in (1, 7, 1000, 1_000_000):
        got = {r.i: r.f for r in df.select("i", fractions.nearest_fraction(F.col("n"), F.col("d"), most).alias("f")).collect()}
        for i, (n, d) in enumerate(pairs):
            if d <= 0:
                assert got[i] is None
                continue
            x = Fraction(n, d)
            want = x.limit_denominator(most)
            mine = Fraction(got[i].num, got[i].den)
            assert (got[i].num, got[i].den) == (mine.numerator, mine.denominator) and got[i].den <= most
            assert mine == want or (n < 0 and abs(mine - x) == abs(want - x)), (n, d, most)
        assert got[998] is None and got[999] is None


def test_rates(spark):
    texts = {"23.976": (2997, 125), "29.97": (2997, 100), "24000/1001": (24000, 1001), " 25 ": (25, 1), "0.5": (1, 2), ".5": (1, 2), "0": None, "-1": None, "x": None, "": None, "1/0": None, "60/2": (30, 1), "29.970029970029970": (30000, 1001), None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.f and (r.f.num, r.f.den) for r in df.select("t", fractions.rate_fraction(F.col("t")).alias("f")).collect()}
    assert got == texts


def test_packed_texts(spark):
    long = "x" * 100
    df = spark.createDataFrame([("short",), (long,), (None,), ("gz:broken",)], "t string")
    packed = df.limit(3).select(files.encoded(F.col("t"), 10).alias("t"))
    assert sorted(map(str, (r.t for r in packed.select(files.decoded(F.col("t")).alias("t")).collect()))) == sorted(["short", long, "None"])
    want = "gz:" + base64.b64encode(gzip.compress(b"ok")).decode()
    got = spark.createDataFrame([(want,), ("gz:broken",)], "t string").select(files.decoded(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == ["ok", None]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(4):
        files.publish(spark.range(n + 1).toDF("i"), path, keep=2)
    assert [k for k, _ in files.snapshots(spark, path)] == [3, 4]
    assert files.latest(spark, path).count() == 4


def test_edit_list_and_script(spark, tmp_path):
    cuts = spark.createDataFrame([("k", 2.0, 4.5, "b'.mp4"), ("k", 0.0, 2.0, "a.mp4")], "k string, s double, e double, c string")
    edl = files.edit_list(cuts, "k", "s", "e", "c")
    assert [(r.n, r.c, r.length) for r in edl.orderBy("n").collect()] == [(1, "a.mp4", 2.0), (2, "b'.mp4", 2.5)]
    files.concat_script(edl, "n", "c", "length", str(tmp_path / "x"))
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert lines.index("a.mp4") < lines.index("b'\\''.mp4") and "duration 2.500" in lines


def test_expiry_and_missing_columns(spark):
    s = spark.createDataFrame([("a", 95.0), ("b", 10.0), ("c", None)], "k string, at double")
    assert [r.k for r in files.unexpired(s, "at", F.lit(100.0), 30).collect()] == ["a"]
    assert files.existing_columns(s, {"k": "string", "missing": "int"}).columns == ["k", "missing"]


def test_short_windows_share_tasks():
    from cadenza.sources import audio

    many = [(f"/{i // 5}", i % 5, i % 5 * 500, 700) for i in range(45_000)]
    packs = audio.packed(many, 64)
    assert [w for p in packs for w in p.windows] == many and 64 <= len(packs) <= 100
    long = [("/a", i, i * audio.PACK, audio.PACK + 5) for i in range(3)]
    assert [len(p.windows) for p in audio.packed(long, 1)] == [1, 1, 1] and len(audio.packed(many[:7], 64)) == 7 and audio.packed([], 4) == []


def test_grams_are_not_broadcast(spark, monkeypatch):
    """Grams of all paths never go through the driver, and names do where they are few; both ways find the same."""
    from cadenza.sources import canvas

    clips = spark.range(500).selectExpr("id as _order", "id as clip", "concat('/m/take_', id, '.mp4') as path")
    names = spark.createDataFrame([("ke_7",), ("zz",), ("7",), ("take_499.mp",)], "name string")
    few = canvas._found(names, clips)
    want = [("7", 7), ("ke_7", 7), ("take_499.mp", 499)]
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(canvas, "FEW", 0)
    many = canvas._found(names, clips)
    assert sorted(map(tuple, many.collect())) == want and "BroadcastHashJoin" not in many._jdf.queryExecution().sparkPlan().toString()
