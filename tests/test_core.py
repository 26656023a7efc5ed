"""Hand-checkable fixtures and properties of the trajectory and scoring jobs."""

import math

import pytest
from pyspark.sql import functions as F

from kinetable.functions import answers as fn
from kinetable.operators import generate, geometry, paired, stats


@pytest.fixture(scope="module")
def clip(spark):
    """180 frames at 30 fps: track 1 moves 2 px a frame, track 2 one, the ball stands still."""
    rows = [("c", t, f, x0 + v * f, y, w, h) for f in range(1, 181) for t, x0, v, y, w, h in ((1, 100.0, 2.0, 300.0, 40.0, 120.0), (2, 400.0, 1.0, 400.0, 40.0, 120.0), (3, 1200.0, 0.0, 450.0, 12.0, 12.0))]
    det = spark.createDataFrame(rows, "seq string, track int, frame int, x double, y double, w double, h double")
    clips = spark.createDataFrame([("c", 30.0, 1920, 1080, 180)], "seq string, fps double, width int, height int, length int")
    return det, clips, geometry.make_windows(clips)


def test_constant_velocity(clip):
    det, clips, windows = clip
    assert [r.f0 for r in windows.orderBy("f0").collect()] == [6, 36, 66, 96]
    full = {(r.track, r.window_index): r for r in geometry.body_metrics(det, clips).where("part = 'full'").collect()}
    assert len(full) == 8 and all(r.stable for r in full.values())
    assert math.isclose(full[1, 0].path_m, 1.93) and math.isclose(full[1, 0].speed, 0.965) and math.isclose(full[2, 3].speed, 0.4825)
    roles = {r.track: r.role for r in geometry.split_roles(det).collect()}
    assert roles == {1: "player", 2: "player", 3: "ball"}


def test_items(clip):
    det, clips, windows = clip
    m = geometry.body_metrics(det, clips)
    items = generate.numeric_items(m, geometry.time_to_intercept(det, m))
    got = {(r.category, r.track, r.answer) for r in items.where("window_index = 0 and reason is null").collect() if r.category != "time"}
    assert got == {("path", 1, "1.9"), ("speed", 1, "1.0"), ("path", 2, "1.0"), ("speed", 2, "0.5")}
    assert generate.accel_swap(m).count() == 0 and generate.faster_pairs(m).count() == 0


def test_gaps(clip):
    det, clips, windows = clip
    one = geometry.body_metrics(det.where("frame <> 20"), clips).where("part = 'full' and path_px is null")
    assert one.count() == 0
    wide = geometry.body_metrics(det.where("not (track = 1 and frame between 80 and 95)"), clips)
    assert {r.window_index for r in wide.where("track = 1 and part = 'full' and path_px is null").collect()} == {1, 2}


def test_depth_gate(clip):
    det, clips, windows = clip
    ramp = det.withColumn("h", F.when(F.col("track") == 1, 120 + F.col("frame") * 0.5).otherwise(F.col("h")))
    got = {(r.track, r.stable) for r in geometry.body_metrics(ramp, clips).where("part = 'full' and window_index = 0").collect()}
    assert got == {(1, False), (2, True)}


def test_parsers(spark):
    rows = ["1.5", "1.5 meters", "nan", "reasoning\nAnswer: 2.0", "1.5f", "1d", "1e400", "-.5", "5.", "", None, "(1.2, 0.3, 0.9)", "3.2 m/s -> 11.5 km/h", "**7**", " 8 "]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    raw = F.col("raw")
    got = df.select(fn.parse_strict(raw).alias("s"), fn.parse_first_number(raw).alias("f"), fn.extract_last_line(raw).alias("l"), fn.parse_tuple3(raw).alias("t")).collect()
    assert [r.s for r in got] == [1.5, None, None, None, None, None, None, -0.5, 5.0, None, None, None, None, None, 8.0]
    assert [r.f for r in got] == [1.5, 1.5, None, 2.0, 1.5, 1.0, 1.0, -0.5, 5.0, None, None, 1.2, 3.2, 7.0, 8.0]
    assert got[3].l == "2.0" and got[13].l == "7" and got[10].l == "" and got[11].t == [1.2, 0.3, 0.9] and got[12].t is None or len(got[12].t) == 2


def test_one_decimal(spark):
    values = [k / 20 for k in range(0, 400)] + [1234.05, 0.15, 2.5, -0.25]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fn.one_decimal(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [f"{v:.1f}" for v in values]


def test_score_scale(spark):
    df = spark.createDataFrame([(3.5, 3.5, 0.3, 1.0), (3.0, 3.5, 0.3, 1.0), (9.0, 0.2, 0.5, 2.0), (None, 1.0, 0.3, 1.0)], "p double, y double, t double, e double")
    c = [F.col(x) for x in "pyte"]
    a = [r[0] for r in df.select(fn.tmra_scaled(*c)).collect()]
    b = [r[0] for r in df.select(fn.tmra_scaled(*(x * 100 for x in c))).collect()]
    assert a == b and a[0] == 100.0 and a[3] is None


def test_ranks(spark):
    rows = [("x", float(a), float(b), float(c)) for a, b, c in zip([1, 2, 2, 5, 4, 6], [2, 1, 3, 4, 6, 5], [2, 2, 1, 3, 4, 3])] + [("const", 1.0, float(i), 1.0) for i in range(4)]
    rows += [("two", 1.0, 2.0, 3.0), ("two", 2.0, 1.0, 1.0)] + [("col", float(a), float(b), float(a)) for a, b in zip([1, 2, 3, 4], [2, 1, 4, 3])]
    df = spark.createDataFrame(rows, "cell string, p double, g double, h double")
    rho = {r.cell: r.rho for r in stats.spearman(df, ["cell"], "p", "g").collect()}
    assert rho["const"] is None and rho["two"] is None and math.isclose(rho["x"], 12.5 / math.sqrt(17 * 17.5))
    part = {r.cell: r.partial for r in stats.partial_spearman(df, ["cell"], "p", "g", "h").collect()}
    assert part["col"] is None and part["x"] is not None


def test_best_constant_is_brute_force(spark):
    ys = [1.0, 1.4, 2.2, 2.3, 2.35, 5.0, 7.5]
    df = spark.createDataFrame([("c", y, 0.3, 1.0) for y in ys], "cell string, reference_value double, score_tolerance double, score_floor double")

    def score(v):
        return sum(10.0 * sum((abs(v - y) - 0.3) / max(abs(y), 1.0) < s for s in fn.STEPS) for y in ys) / len(ys)

    got = stats.best_constant(df, ["cell"]).first()
    assert math.isclose(got.tmra, max(score(k / 1000) for k in range(8000))) and math.isclose(score(got.constant), got.tmra)


def test_evaluator_smoke(spark):
    rows = [("dynamics_speed_player", "2.0", "2.0", True), ("dynamics_speed_player", "2.0", None, False)]
    df = spark.createDataFrame(rows, "category string, answer string, vlm_answer string, has_prediction boolean")
    r = {x.grp: x for x in stats.evaluate_summary(df).collect()}["overall"]
    assert (r.n, r.coverage, r.tmra) == (2, 0.5, 0.5)


def test_conversion_classes(spark):
    df = spark.createDataFrame([(250.0,), (2.5,), (0.025,), (25.0,), (300.0,), (None,)], "p double")
    c = fn.classify_conversion(F.col("p"), F.lit(2.5), F.lit(100.0), F.lit(250.0))
    assert [r[0] for r in df.select(c).collect()] == ["correct", "identity", "wrong_direction", "decade_error", "other", "unparsed"]


def test_mcnemar(spark):
    df = spark.createDataFrame([(0, 0), (1, 9), (5, 5)], "b int, c int")
    got = [r[0] for r in df.select(paired.mcnemar_p("b", "c")).collect()]
    assert got[0] == 1.0 and math.isclose(got[1], 22 / 1024) and got[2] == 1.0


def test_mixed_units_are_exact_halves(spark):
    df = spark.createDataFrame([("c", "speed", i, f"{i}.2") for i in range(10)], "seq string, category string, track int, answer string")
    got = generate.mixed_units(df, ["seq", "category"], ["track"]).collect()
    assert sum(r.unit == "cm" for r in got) == 5
    assert all(r.answer == (f"{r.track}20.0" if r.unit == "cm" else f"{r.track}.2").lstrip("0") or r.track == 0 for r in got)


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "kinetable", tmp_path / "kinetable", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'numeric_items' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_accel_visual_is_the_greedy_choice(spark):
    """Against a plain statement of the rule: all disjoint pairs by (distance, up, down), each window once."""
    import random

    from kinetable.operators.more_geometry import accel_visual

    r = random.Random(3)
    rows, want = [], set()
    for track in range(25):
        n, win = r.randint(1, 40), r.choice([30, 60, 75])
        mine = [(k, 6 + 30 * k, 6 + 30 * k + win, r.random() < 0.4) for k in range(n) if r.random() < 0.8]
        rows += [("c", track, k, a, b, up) for k, a, b, up in mine]
        pairs = sorted((abs(u[0] - d[0]), u[0], d[0]) for u in mine if u[3] for d in mine if not d[3] and (u[2] < d[1] or d[2] < u[1]))
        used = set()
        for _, u, d in pairs:
            if not {u, d} & used:
                used |= {u, d}
                want.add((track, u, d))
    df = spark.createDataFrame(rows, "seq string, track int, window_index int, a int, b int, up boolean")
    got = accel_visual(df).collect()
    assert {(x.track, x.up, x.down) for x in got} == want and len(got) == len(want) > 20
    assert all(sorted(x.k for x in got if x.track == t) == list(range(sum(x.track == t for x in got))) for t in range(25))


def test_legacy_groups_and_scores(spark):
    rows = [
        ("distance_measurement_x", "2.0", "2.3"), ("Localization", "(1, 1, 1)", "(1.1, 1.1, 1.1)"), ("Localization", "(0, 1, 1)", "(0, 1.0, 1)"), ("localization", "(1, 1, 1)", "1 and 1"), ("spatial_counting_people", "3", " 3 "),
        ("relational_reasoning_dyn_faster", "A", "a"), ("distance", "1", "1"), ("dynamics_time_intercept", "0.0", "0.2"),
    ]
    df = spark.createDataFrame(rows, "category string, answer string, said string").withColumn("grp", fn.map_group(F.col("category")))
    v1, v2 = (fn.score_pair(F.col("grp"), F.col("said"), F.col("answer"), v) for v in ("legacy_v1", "floor_v2"))
    got = df.select("grp", v1.alias("a"), v2.alias("b"), fn.within_30cm(F.col("said"), F.col("answer")).alias("near"), fn.parse_failure(F.col("grp"), F.col("said")).alias("failed")).collect()
    assert [r.grp for r in got] == ["distance", "localization", "localization", "localization", "counting", "relational", "other", "timing"]
    assert [r.a.exact for r in got] == [False, False, True, False, True, True, True, False]
    # tolerance of distances is 15 cm: (0.3 - 0.15) / 2 = 0.075 stays under nine... ten steps but the last (0.05)
    assert math.isclose(got[0].a.tmra, 0.9) and math.isclose(got[1].a.tmra, 1.0) and got[3].a.tmra == 0.0 and got[6].a.tmra is None
    assert got[7].a.tmra == 0.0 and got[7].b.tmra == 1.0  # a truth of 0 has a denominator only with a floor
    assert [r.near for r in got][1:4] == [True, True, False] and [r.failed for r in got][1:4] == [False, False, True]


def test_conforms(spark):
    rows = [("relational", "b", "A", True), ("counting", "12", "3", True), ("counting", "12", "A", False), ("distance", "2.5 m", "2", True), ("distance", "about 2", "2", False), ("speed", "1.2m/s", "1", True), ("speed", "1.2 m", "1", False), ("timing", "3 seconds", "1", True), ("localization", "1, 2 and 3", "", True), ("localization", "1, 2", "", False), ("other", None, "", True)]
    df = spark.createDataFrame(rows, "g string, a string, t string, want boolean")
    assert all(r.want == r.got for r in df.select("want", fn.conforms(F.col("g"), F.col("a"), F.col("t")).alias("got")).collect())


def test_read_then_convert(spark):
    rows = [("3.2 m/s -> 11.5 km/h", 11.5, 3.2, "km/h"), (" 2 m->200 cm. ", 200.0, 2.0, "cm"), ("3.2 -> 5 km", None, None, None), (None, None, None, None), ("1.5", None, None, None)]
    df = spark.createDataFrame(rows, "raw string, v double, r double, u string")
    for x in df.select("*", fn.parse_read_then_convert(F.col("raw")).alias("p")).collect():
        assert (x.p.value, x.p.reading, x.p.unit) == (x.v, x.r, x.u)


def test_diagnostic_rounds_half_even(spark):
    df = spark.createDataFrame([(0.15, 0.2), (2.5, 250.0), (0.02, 0.00002)], "v double, t double")
    assert [r[0] for r in df.select(fn.is_diagnostic(F.col("v"), F.col("t"))).collect()] == [True, True, False]


def test_seed_labels(spark):
    from kinetable.operators import rules

    cases = {"a": ("replicates",) * 3, "b": ("replicates", "replicates", "intermediate"), "c": ("replicates", "replicates", "fails"), "d": ("fails", "fails", "intermediate"), "e": ("fails", "intermediate", "intermediate"), "f": ("replicates", "fails", "fails"), "g": ("replicates", "replicates")}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v string")
    assert {r.k: r.label for r in rules.seed_label(df, ["k"], "v").collect()} == {
        "a": "holds at all three seeds", "b": "holds at two of three seeds", "c": "seed-dependent", "d": "fails across seeds", "e": "not established", "f": "seed-dependent", "g": "pending"
    }


def test_crop_has_a_fixed_size(spark):
    from kinetable.operators.more_geometry import crop_rect

    rows = [("mid", 900.0, 500.0, 40.0, 120.0), ("mid", 940.0, 500.0, 40.0, 120.0), ("edge", 5.0, 900.0, 40.0, 120.0), ("wide", 0.0, 0.0, 40.0, 120.0), ("wide", 500.0, 0.0, 40.0, 120.0)]
    df = spark.createDataFrame(rows, "i string, x double, y double, w double, h double")
    got = {r.i: (r.left, r.top, r.w, r.h) for r in crop_rect(df, ["i"], 1920, 1080, 480, 270).collect()}
    assert got == {"mid": (700, 425, 480, 270), "edge": (0, 810, 480, 270), "wide": (None,) * 4}


def test_frame_modes(spark):
    from kinetable.operators.variants import frame_mode

    df = spark.createDataFrame([("x", [1, 2, 3]), ("y", [5]), ("z", [1, 2])], "k string, f array<int>")
    for r in df.select("f", *(frame_mode(F.col("f"), F.col("k"), m).alias(m) for m in ("full", "single", "static4", "shuffle"))).collect():
        assert r.full == r.f and r.single == r.f[:1] and r.static4 == [r.f[0]] * len(r.f)
        assert sorted(r.shuffle) == sorted(r.f) and (len(r.f) < 2 or r.shuffle != r.f)


def test_unit_probe_has_its_published_size(spark):
    from kinetable.operators import probe

    q = probe.unit_probe_items(spark.createDataFrame([(v,) for v in probe.VALUES], "value double"))
    rows = q.collect()
    assert len(rows) == 392 and sum(r.published for r in rows) == 12 and len({r.item_id for r in rows}) == 392
    assert q.where(fn.is_diagnostic(F.col("value"), F.col("target"))).count() == 246


def test_pool_and_variants(clip):
    det, clips, windows = clip
    m = geometry.body_metrics(det, clips)
    balls = geometry.split_roles(det).where("role = 'ball'").select("seq", F.col("track").alias("ball"))
    rows = generate.numeric_rows(generate.numeric_items(m, geometry.time_to_intercept(det, m)), windows, balls)
    assert rows.columns == generate.ROWS
    one = rows.where("category = 'dynamics_speed_player' and track = 1 and window_index = 0").first()
    assert one.answer == "1.0" and "1.93 m tall" in one.question and one.question.endswith("one decimal place.") and one.image_ids[0] == "c_w0_t1_f6" and one.frames == [6, 26, 46, 66]
    assert all(len(r.highlight) == (2 if "time" in r.category else 1) for r in rows.collect())


def test_invariants_of_arms(clip):
    det, clips, _ = clip
    m = geometry.body_metrics(det, clips)
    arms = generate.control_arms(generate.numeric_items(m, geometry.time_to_intercept(det, m)))
    assert {r.rule: r.violations for r in generate.arm_invariants(arms).collect()} == {"reference": 0, "unit_text": 0, "prior_text": 0, "scale": 0}
    hurt = arms.withColumn("answer", F.when((F.col("arm") == "m_height") & (F.col("category") == "speed"), "9.9").otherwise(F.col("answer"))).withColumn("question", F.when(F.col("arm") == "cm_height", F.concat("question", F.lit(" Now."))).otherwise(F.col("question")))
    bad = {r.rule: r.violations for r in generate.arm_invariants(hurt).collect()}
    assert bad["reference"] > 0 and bad["unit_text"] > 0 and bad["prior_text"] > 0


def test_samples_ignore_how_a_group_is_cut(spark):
    from kinetable.operators import pools

    df = spark.range(5000).select("id", (F.col("id") % 7 == 0).alias("g"))
    got = {(r.g, r.id) for r in pools.select_per_stratum(df, ["g"], "id", 30).collect()}
    assert got == {(i % 7 == 0, i) for g in (True, False) for i in sorted(i for i in range(5000) if (i % 7 == 0) == g)[:30]}
    spaced = sorted(r.id for r in pools.evenly_spaced_pick(df, ["g"], "id", 60).where("g").collect())
    own = [i for i in range(5000) if i % 7 == 0]
    assert spaced == [own[k * len(own) // 60] for k in range(60)]


def test_audit_of_pairs(spark):
    from kinetable.operators import audit

    rows = [("ok", "A", "q", 0, 9, [0, 9]), ("ok", "B", "q", 20, 29, [20, 29]), ("same", "A", "q", 0, 9, [0]), ("same", "A", "q", 20, 29, [20]), ("c", "A", "q", 0, 9, [0]), ("c", "C", "q", 20, 29, [20]), ("text", "A", "q", 0, 9, [0]), ("text", "B", "p", 20, 29, [20])]
    rows += [("near", "A", "q", 0, 9, [0]), ("near", "B", "q", 9, 29, [20]), ("frames", "A", "q", 0, 9, [7]), ("frames", "B", "q", 20, 29, [7]), ("one", "A", "q", 0, 9, [0])]
    df = spark.createDataFrame(rows, "pair_id string, answer string, question string, f0 int, f1 int, frames array<int>")
    assert {r.pair_id: r.reason for r in audit.audit_pairs(df).collect()} == {"same": "answers", "c": "answers", "text": "text", "near": "windows", "frames": "frames", "one": "rows"}
    pool = df.select(F.col("pair_id").alias("image_id"), "question", "answer")
    assert {r.problem: r.n for r in audit.audit_pool(pool).collect()} == {"balance": 3, "repeated": 5}


def test_halves_of_a_hot_stratum_and_digests_of_several_levels(spark):
    import hashlib

    from kinetable.operators import frames, generate

    rows = [("hot", i, "1.5") for i in range(3001)] + [("two", i, "2.0") for i in range(2)] + [("one", 0, "3.0")] + [(None, i, "4.0") for i in range(6)]
    items = spark.createDataFrame(rows, "stratum string, k int, answer string")
    got = generate.mixed_units(items, ["stratum"], ["stratum", "k"]).collect()
    assert len(got) == len(rows)
    for s, n in (("hot", 3001), ("two", 2), ("one", 1), (None, 6)):
        own = sorted(((hashlib.sha256('|'.join(x for x in ('mixed', s, str(r.k)) if x is not None).encode()).hexdigest(), r) for r in got if r.stratum == s), key=lambda x: x[0])
        assert [r.unit for _, r in own] == ["cm"] * (n // 2) + ["m"] * (n - n // 2)
        assert all(r.answer == {"hot": "150.0", "two": "200.0", None: "400.0"}[s] for _, r in own if r.unit == "cm")

    def plain(n, parts):
        level = [f"{p}:" + hashlib.sha256(f'{{"a":"x{p}"}}'.encode()).hexdigest() for p in range(n)]
        depth = 0
        while depth < 2 or len(level) > 1:
            level = [hashlib.sha256("|".join(level[i : i + parts]).encode()).hexdigest() for i in range(0, len(level), parts)]
            depth += 1
        return level[0]

    for n in (1, 4, 5, 17, 70):
        samples = spark.createDataFrame([(p, f"x{p}") for p in range(n)], "place int, a string")
        r = frames.sequence_digest(samples, "place", 4).first()
        assert (r.n, r.digest) == (n, plain(n, 4))
    assert frames.sequence_digest(samples.limit(0), "place", 4).count() == 0
