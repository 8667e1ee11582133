"""Hot groups: the paths that large images and busy sessions take, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from veilspan.operators import boxes, sessions

RECT = "rect struct<x:int,y:int,w:int,h:int>"


def shared(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(0, w) * max(0, h)


def iou(a, b):
    s = shared(a, b)
    return s / (a[2] * a[3] + b[2] * b[3] - s) if s else 0.0


def overlap(a, b):
    least = min(a[2] * a[3], b[2] * b[3])
    return shared(a, b) / least if least > 0 else 0.0


def bounding(a, b):
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return (x, y, max(0, a[0] + a[2], b[0] + b[2]) - x, max(0, a[1] + a[3], b[1] + b[3]) - y)


def hot_boxes(n_hot=160, n_small=5, seed=1, spread=300):
    """One image with most boxes, some images with few."""
    rng = random.Random(seed)
    rows = []
    for img, n in [(0, n_hot)] + [(i, n_small) for i in range(1, 6)]:
        for k in range(n):
            r = (rng.randrange(-20, spread), rng.randrange(-20, spread), rng.randrange(5, 60), rng.randrange(5, 60))
            rows.append((img, k, round(rng.random(), 6), rng.choice(["email", "phone"]), dict(zip("xywh", r))))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, f"img int, k int, score double, category string, {RECT}")


def as_tuple(r):
    return (r["x"], r["y"], r["w"], r["h"])


def test_nms_of_an_overfull_image(spark):
    rows = hot_boxes()
    got = boxes.nms(table(spark, rows), ["img"], [-F.col("score"), F.col("k")], 0.1, chunk=16)
    want = set()
    for img in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[2], r[1])):
            if all(iou(as_tuple(r[4]), k) <= 0.1 for k in kept):
                kept.append(as_tuple(r[4]))
                want.add((img, r[1]))
    assert {(r["img"], r["k"]) for r in got.collect()} == want


def test_cluster_of_an_overfull_image(spark):
    rows = hot_boxes(seed=2, spread=900)
    df = table(spark, rows).select("img", "rect", "k")
    got = sorted((r["img"], as_tuple(r["rect"]), r["n"]) for r in boxes.cluster(df, ["img"], [F.col("k")], 0.3, chunk=16).collect())
    want = []
    for img in {r[0] for r in rows}:
        groups = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: r[1]):
            box = as_tuple(r[4])
            for g in groups:
                if overlap(g[0], box) > 0.3:
                    g[0], g[1] = bounding(g[0], box), g[1] + 1
                    break
            else:
                groups.append([box, 1])
        want += [(img, g[0], g[1]) for g in groups]
    assert got == sorted(want)


def test_dedupe_of_an_overfull_image(spark):
    rows = hot_boxes(seed=3)
    df = table(spark, rows).select(
        "img", "category", "rect", F.col("score").alias("confidence"), F.lit("text").alias("source"),
        F.col("k").cast("string").alias("match"), (F.col("k") % 5 == 0).alias("has_landmarks"), "k",
    )
    got = boxes.dedupe(df, ["img", "category"], [F.col("k")], chunk=8)
    got = sorted((r["img"], r["category"], as_tuple(r["rect"]), r["match"]) for r in got.collect())
    want = []
    for key in {(r[0], r[3]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[0], r[3]) == key), key=lambda r: r[1]):
            box, marks = as_tuple(r[4]), r[1] % 5 == 0
            same = next((g for g in kept if overlap(g[0], box) > 0.5 and g[2] == marks), None)
            if same is None:
                kept.append([box, str(r[1]), marks])
            elif box[2] * box[3] < same[0][2] * same[0][3]:
                same[0], same[1] = box, str(r[1])
            elif overlap(same[0], box) < 0.99:
                same[0] = bounding(same[0], box)
        want += [(*key, g[0], g[1]) for g in kept]
    assert got == sorted(want)


def test_strips_do_not_cut_boxes(spark):
    rows = hot_boxes(seed=4, spread=2000)
    out = boxes.strips(table(spark, rows), ["img"]).collect()
    assert len(out) == len(rows)
    for a in out:
        for b in out:
            if a["img"] == b["img"] and shared(as_tuple(a["rect"]), as_tuple(b["rect"])):
                assert (a["_sx"], a["_sy"]) == (b["_sx"], b["_sy"])
    assert len({(r["_sx"], r["_sy"]) for r in out if r["img"] == 0}) > 5


def test_copies_of_one_box_are_matched_once(spark):
    """A box repeated many times makes one pair, not a square of them."""
    hot = [(1, i, 0.5, "email", dict(x=10, y=10, w=20, h=20)) for i in range(500)]
    a, b = table(spark, hot), table(spark, hot)
    pairs = boxes.meeting(
        boxes.distinct_boxes(a, ["img"], "a_rect").drop("_copies"), boxes.distinct_boxes(b, ["img"], "b_rect").drop("_copies"), ["img"]
    )
    assert pairs.count() == 1
    best = boxes.best_partner(a, b, ["img"], "category").collect()
    assert [(r["copies"], r["best_iou"], r["agrees"]) for r in best] == [(500, 1.0, True)]
    tagged = boxes.first_overlapping(a, b.withColumnRenamed("category", "tag"), ["img"], F.col("k"), "tag")
    assert tagged.where("tag = 'email'").count() == 500


def test_meeting_finds_every_pair_once(spark):
    rows = hot_boxes(seed=5)
    df = table(spark, rows)
    a = boxes.distinct_boxes(df, ["img"], "a_rect").drop("_copies")
    b = boxes.distinct_boxes(df, ["img"], "b_rect").drop("_copies")
    got = [(r["img"], as_tuple(r["a_rect"]), as_tuple(r["b_rect"])) for r in boxes.meeting(a, b, ["img"]).collect()]
    per = {}
    for r in rows:
        per.setdefault(r[0], set()).add(as_tuple(r[4]))
    want = {(i, p, q) for i, rs in per.items() for p in rs for q in rs if shared(p, q)}
    assert len(got) == len(set(got)) and set(got) == want


def events(n=600, seed=7):
    """One session holds most of the events."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(seconds=rng.choice([rng.randrange(4000), rng.randrange(90000)]), microseconds=rng.randrange(10**6))
        rows.append((i, 0 if rng.random() < 0.7 else rng.randrange(1, 5), at, rng.choice(list(sessions.TRANSITIONS) + ["other"]), round(rng.random() * 20)))
    return rows


def steps(spark, rows):
    return spark.createDataFrame(rows, "event_id long, session int, ts timestamp, event string, ms long")


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_lag_and_best_across_slices(spark):
    rows = events()
    df = steps(spark, rows)
    got = {r["event_id"]: r["before"] for r in sessions.with_previous(df, "session", ["ts", "event_id"], "event_id", "before", "1 minute").collect()}
    best = {r["event_id"]: (r["best_ms"], r["best_event"]) for r in sessions.running_best(df, "session", ["ts", "event_id"], "ms", "event", "1 minute").collect()}
    for rs in by_session(rows).values():
        top = None
        for prev, r in zip([None, *rs], rs):
            assert got[r[0]] == (prev[0] if prev else None)
            if top is None or r[4] >= top[4]:
                top = r
            assert best[r[0]] == (top[4], top[3])


def test_states_and_gaps(spark):
    rows = events(seed=8)
    df = steps(spark, rows)
    got = {r["session"]: (r["state"], r["n_events"]) for r in sessions.final_states(df, "session", ["ts", "event_id"], "event").collect()}
    gaps = sorted((r["session"], r["started"], r["n_steps"]) for r in sessions.gap_sessions(df, "session", ["ts", "event_id"], 180).collect())
    want_gaps = []
    for key, rs in by_session(rows).items():
        state = "idle"
        for r in rs:
            state = sessions.TRANSITIONS[r[3]][sessions.STATES.index(state)] if r[3] in sessions.TRANSITIONS else state
        assert got[key] == (state, len(rs))
        runs = []
        for prev, r in zip([None, *rs], rs):
            if prev is None or (r[2] - prev[2]).total_seconds() > 180:
                runs.append([key, r[2], 0])
            runs[-1][2] += 1
        want_gaps += [tuple(x) for x in runs]
    assert gaps == sorted(want_gaps)


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    from veilspan import session

    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        sparkContext, conf = Context(), Conf()

    try:
        session.shared_folder(Cluster(), "x")
    except RuntimeError:
        return
    raise AssertionError("a cluster without a shared folder must be refused")


def test_small_images_meet_without_a_grid_and_crowded_ones_in_cells(spark):
    """A box of a small image is not copied into cells; a crowded image beside it gives the same rows as ever."""
    small, both = table(spark, hot_boxes(n_hot=5)), table(spark, hot_boxes(n_hot=boxes.FEW + 30))
    for rows, in_cells in ((small, False), (both, True)):
        other = rows.withColumnRenamed("category", "tag")
        found = [boxes.first_overlapping(rows, other, ["img"], F.col("k"), "tag"), boxes.best_partner(rows, rows, ["img"], "category"), boxes.coverage(rows, rows, ["img"])]
        for one in found:
            assert ("_cx" in one._jdf.queryExecution().optimizedPlan().toString()) == in_cells
        listed = [(r["img"], r["k"], as_tuple(r["rect"]), r["category"]) for r in rows.collect()]
        want = {}
        for img, k, box, _ in listed:
            near = [(j, tag) for i, j, o, tag in listed if i == img and overlap(box, o) > 0.5]
            want[img, k] = min(near)[1] if near else None
        assert {(r["img"], r["k"]): r["tag"] for r in found[0].collect()} == want
        assert sum(r["copies"] for r in found[1].collect()) == len(listed) == sum(r["copies"] for r in found[2].collect())
