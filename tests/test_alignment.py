"""Literal cases and properties of the alignment operators, and the DuckDB comparison on the smallest tables.

Texts, times and results of the literal cases are fixed values.
"""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import align, changes, gates, path, scores, segments, structure
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_scalars(spark):
    r = one(spark, slug=T.slug(F.lit("/tmp/4.1BERT-2训练.mp4")), a=T.hms(F.lit(0.0)), b=T.hms(F.lit(12.4)), c=T.hms(F.lit(450.049)), s=T.stamp(F.lit(3723.0)), t=T.slide_text(F.lit("RNN整体网络结构 ǜ֩−1")), f=T.formulas(F.array(F.lit("再计算 P(y_i)=e^{z_i}/sum_j e^{z_j}。"))), h=T.heading(F.lit("本段讲解了 BERT 输入构造")), k=T.tokens(F.lit("The a 网络 网 RNN_x")), u=T.unique_points(F.array(F.lit("one point"), F.lit("one point"), F.lit("other"), F.lit("a point")), 5))
    assert (r["slug"], r["a"], r["b"], r["c"], r["s"]) == ("4-1bert-2训练", "00:00:00", "00:00:12", "00:07:30", "[01:02:03]")
    assert r["t"] == "RNN整体网络结构" and r["f"] == ["P(y_i)=e^{z_i}/sum_j e^{z_j}"] and r["h"] == "BERT 输入构造"
    assert r["k"] == ["the", "网络", "rnn"] and r["u"] == ["one point", "other", "a point"]


def test_bucket_argmax(spark):
    rows = [(1, 1, 20.0, 40.0, "x" * 80), (1, 2, 130.0, 170.0, "x" * 120), (1, 3, 250.0, 290.0, "x" * 120), (1, 4, 360.0, 410.0, "x" * 140), (1, 5, 449.0, 450.0, "")]
    u = spark.createDataFrame(rows, "stream_id long, index long, start double, end double, text string")
    assert [r["at"] for r in changes.bucket_best(u).orderBy("bucket").collect()] == [30, 150, 270, 385]


def test_supplements(spark):
    p = spark.createDataFrame([(1, 0, 450.0, False), (1, 37, 450.0, True), (1, 74, 450.0, True)], "stream_id long, at long, duration double, weak boolean")
    assert sorted(r["at"] for r in changes.supplements(p).collect()) == [25, 49, 62, 86]


def test_upsert(spark):
    a = spark.createDataFrame([(1, 37, "a"), (1, 74, "a")], "stream_id long, at long, v string")
    b = spark.createDataFrame([(1, 37, "b"), (1, 49, "b")], "stream_id long, at long, v string")
    assert sorted((r["at"], r["v"]) for r in changes.upsert(a, b, ["stream_id", "at"]).collect()) == [(37, "b"), (49, "b"), (74, "a")]


FRAME = "stream_id long, event_id long, ts double, change_ratio double, component_ratio double, scene_score double, phash string, ocr_text string"


def frames_of(spark, rows):
    """rows: (ts, change ratio, largest part, hash, text)."""
    return spark.createDataFrame([(1, i, float(t), c, p, 0.0, h, x) for i, (t, c, p, h, x) in enumerate(rows)], FRAME)


def test_retro_mark(spark):
    got = [(r["change_kind"], r["reason"]) for r in changes.change_kinds(frames_of(spark, [(0, 0.0, 0.0, "", "aa bb"), (10, 0.0, 0.0, "", "aa bb"), (20, 0.0, 0.0, "", "aa bb"), (30, 0.5, 0.0, "", "cc dd")])).orderBy("ts").collect()]
    assert got == [("no_change", "opening_frame"), ("no_change", ""), ("no_change", "stable_before_change"), ("page_change", "closing_frame")]


def test_broad_changes(spark):
    # 0.1 of the pixels is a page's change only if a part of 0.02 changes; a text that stays the same never is one.
    rows = [(0, 0.0, 0.0, "", "aa bb"), (10, 0.1, 0.01, "", "cc dd"), (20, 0.0, 0.0, "", "cc dd"), *[(30 + i, 0.0, 0.0, "", "cc dd") for i in range(5)], (40, 0.1, 0.02, "", "ee ff"), *[(50 + i, 0.0, 0.0, "", "ee ff") for i in range(5)], (60, 0.5, 0.5, "", "ee ff")]
    got = changes.change_kinds(frames_of(spark, rows)).orderBy("ts").collect()
    assert {r["ts"]: r["change_kind"] for r in got if r["change_kind"] != "no_change"} == {10.0: "annotation_like_change", 40.0: "page_change", 60.0: "annotation_like_change"}
    assert got[0]["similarity"] == 0.0


def test_units(spark):
    text = "recognised words of a page with enough to say"
    rows = [(0, 0.0, 0.0, "a" * 16, text + " one"), (10, 0.0, 0.0, "a" * 15 + "b", text + " two"), (20, 0.0, 0.0, "b" * 16, "other matter entirely")]
    frames = frames_of(spark, rows).withColumn("candidate", F.lit(False)).withColumn("change_kind", F.lit("no_change"))
    got = changes.visual_units(frames).orderBy("unit_number").collect()
    assert [(r["unit_id"], r["frame_count"], r["low"]) for r in got] == [("visual_unit_001", 2, False), ("visual_unit_002", 1, False)]
    # With candidates, only these and the ends are pages.
    marked = frames.withColumn("candidate", F.col("event_id") == 0)
    assert [r["frames"] for r in changes.visual_units(marked).orderBy("unit_number").collect()] == ["0", "2"]


def test_representative_is_nearest_to_the_mean(spark):
    rows = [(0, 0.0, 0.0, "a" * 16, "same text"), (1, 0.0, 0.0, "a" * 16, "same text"), (2, 0.0, 0.0, "a" * 16, "same text"), (100, 0.0, 0.0, "a" * 16, "same text")]
    # The mean is 25.75, the middle of the ends 50: the mean's nearest is the third.
    assert changes.representatives(changes.clusters(frames_of(spark, rows))).first()["event_id"] == 2


def test_change_scan(spark):
    # Ten samples a second apart, one jump after the fifth; a gap of two seconds.
    rows = [(i, 1.0 if i == 5 else 0.0, 1.0 if i == 5 else 0.0, "", "") for i in range(10)]
    got = changes.change_points(frames_of(spark, rows).withColumn("duration", F.lit(10.0)), gap=2)
    assert sorted(r["at"] for r in got.collect()) == [0, 4, 9]


def test_thinned():
    assert changes.thinned([(0, 1.0), (4, 5.0), (9, 2.0), (20, 1.0)], 8) == [(4, 5.0), (20, 1.0)]
    assert changes.thinned([(0, 1.0), (4, 1.0)], 8) == [(4, 1.0)]


def test_page_titles(spark):
    cases = [("目录", "目录"), ("Deep nets | more", "Deep nets"), ("Attention a b c d", "Attention"), ("x" * 90 + " | RNN 结构", "RNN 结构"), ("输 入 层 结构", "输 入"), ("", "Slide 7"), ("❄❄❄ | ok title", "ok title")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert [r["x"] for r in df.select(T.page_title(F.col("t"), F.lit(7)).alias("x")).collect()] == [b for _, b in cases]


def test_segmentation_keeps_order_and_all():
    rng = random.Random(4)
    for _ in range(200):
        rows, t = [], 0.0
        for _ in range(rng.randint(0, 30)):
            rows.append((t, t + rng.randint(1, 60), "x" * rng.randint(1, 150) + rng.choice(["", "。", "."])))
            t = rows[-1][1]
        g = segments.grouped(rows)
        assert len(g) == len(rows) and all(b - a in (0, 1) for a, b in itertools.pairwise(g))
    assert segments.grouped([(0, 5, "一二三"), (5, 10, "四五六。"), (20, 25, "七八九")], max_chars=8, max_span=12) == [0, 0, 1]


def test_path_is_best():
    rng = random.Random(2)
    for _ in range(60):
        rows = [[(i, float(rng.randint(0, 60))) for i in rng.sample(range(1, 12), rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        found = path.Path(rows)

        def worth(places, rows=rows):
            p = [rows[n][k] for n, k in enumerate(places)]
            return path.opening(*p[0])[0] + sum(s for _, s in p) + sum(path.step(b[0] - a[0])[0] for a, b in itertools.pairwise(p))

        best = max(worth(c) for c in itertools.product(*(range(len(r)) for r in rows)))
        assert abs(worth(found.chosen) - best) < 1e-9
        assert all(abs(f[k] + a[k] - best) < 1e-9 for f, a, k in zip(found.forward, found.after, found.chosen, strict=True))


def test_order_beyond_999_segments(spark):
    # The path must go 1, 2, 3, .. by number: by text, segment_1000 would stand between 100 and 101.
    ids = [f"segment_{n:03d}" for n in range(1, 1102)]
    rows = [(1, n + 1, s, n // 4 + k, 1.0, k + 1) for n, s in enumerate(ids) for k in range(2)]
    got = path.slide_paths(spark.createDataFrame(rows[::-1], "stream_id long, segment_number int, segment_id string, slide_index int, score double, rank int")).collect()
    chosen = path.Path([[(n // 4, 1.0), (n // 4 + 1, 1.0)] for n in range(len(ids))]).chosen
    assert {r["segment_id"]: r["slide_index"] for r in got if r["selected"]} == {s: n // 4 + c for n, (s, c) in enumerate(zip(ids, chosen, strict=True))}

    visual = "array<struct<id:string,score:double,ts:double,title:string,ocr_text:string,relative_path:string>>"
    aligned = spark.createDataFrame([(1, n + 1, s, "", f"t{n}", "", float(n), n + 1.0) for n, s in enumerate(ids)], "stream_id long, segment_number int, segment_id string, summary string, text string, cleaned_text string, start double, end double").withColumn("selected_visuals", F.array().cast(visual))
    sections = structure.outline(aligned)
    assert [r["segment_id"] for r in sections.orderBy("number").collect()] == ids
    assert {r["segment_id"]: r["section_id"] for r in sections.collect()} == {s: s.replace("segment", "section") for s in ids}
    assert structure.ordered_lines(sections, "number", F.array("segment_id")).first()["markdown"] == ids


def aligned_one(spark, segments, units=(), slides=(), frames=()):
    """Modes of segments (number, start, end, summary, text) against units, slides and frames, by the ladder."""
    s = spark.createDataFrame([(1, n, f"segment_{n:03d}", float(a), float(b), m, [], x, "", [], 1, "slides-first" if slides else "video-first") for n, a, b, m, x in segments], "stream_id long, segment_number int, segment_id string, start double, end double, summary string, issues array<string>, text string, cleaned_text string, hints array<string>, deck int, source_mode string")
    u = spark.createDataFrame([(1, n, f"visual_unit_{n:03d}", n, float(t), x, low) for n, t, x, low in units], "stream_id long, unit_number int, unit_id string, event_id int, ts double, ocr_text string, low boolean").withColumn("tokens", T.tokens(F.col("ocr_text")))
    p = spark.createDataFrame([(1, i, t, x, f"s{i}", low) for i, t, x, low in slides], "deck int, slide_index int, title string, text string, relative_path string, low boolean")
    f = spark.createDataFrame([(1, n, float(t), x) for n, t, x in frames], "stream_id long, event_id int, ts double, ocr_text string")
    rows = align.alignment(scores.with_tokens(s), f, p, u).orderBy("segment_number").collect()
    return [(r["mode"], [v["id"] for v in r["selected_visuals"]], r["borrow_reason"] != "", r["reject_reason"] != "") for r in rows]


def test_mode_ladder(spark):
    said = [(1, 0, 40, "about attention", "attention heads CLS")]
    assert aligned_one(spark, said, slides=[(4, "attention heads", "x", False), (5, "attention heads", "x", True)]) == [("ppt_slide_match", ["slide_004"], False, False)]
    assert aligned_one(spark, said, units=[(1, 182, "attention heads", False), (2, 22, "attention heads", False)]) == [("visual_unit_nearby", ["visual_unit_002"], False, False)]
    assert aligned_one(spark, said, units=[(1, 400, "attention heads", False)]) == [("visual_unit_global", ["visual_unit_001"], False, False)]
    # Weight 0.75 is too little from afar.
    assert aligned_one(spark, said, units=[(1, 181, "CLS", False)]) == [("none", [], False, True)]
    assert aligned_one(spark, said, units=[(1, 22, "attention", True)]) == [("suppressed_low_value", [], False, True)]
    # Two good units lend; the nearer comes first. A lone word of weight 0 is no overlap.
    assert aligned_one(spark, said, units=[(1, 22, "attention", True), (2, 110, "CLS", False), (3, 90, "CLS", False), (4, 80, "transformer", False)]) == [("borrowed_nearby_visual", ["visual_unit_003", "visual_unit_002"], True, False)]
    assert aligned_one(spark, said, frames=[(7, 50, "words"), (8, 300, "attention")]) == [("frame_fallback", ["frame_8"], True, False)]


def test_titles_are_looked_for_as_written(spark):
    s = scores.with_tokens(spark.createDataFrame([(1, 1, "segment_001", "Net and 网 here", [], "", "", [], 1)], "stream_id long, segment_number int, segment_id string, summary string, issues array<string>, text string, cleaned_text string, hints array<string>, deck int"))
    p = spark.createDataFrame([(1, 1, "Net and"), (1, 2, "net and"), (1, 3, "网"), (1, 4, "et a"), (1, 5, "Net and 网 herewith"), (2, 6, "Net and")], "deck int, slide_index int, title string")
    assert sorted(r["slide_index"] for r in scores.exact_titles(s, p).collect()) == [1, 3, 4]


def test_slides_are_sent_to_the_segments(spark):
    # Hits were dealt by deck and token, and the text once for every start of a title: more disk than the job may have.
    s = scores.with_tokens(spark.createDataFrame([(n, 1, "segment_001", f"Net and 网 {'cls' * (n % 2)} w{n % 5} here", [], "", "", [], n % 3) for n in range(30)], "stream_id long, segment_number int, segment_id string, summary string, issues array<string>, text string, cleaned_text string, hints array<string>, deck int"))
    p = spark.createDataFrame([(d, 5 * d + k, t, f"w{k} here cls", k == 4) for d in range(4) for k, t in enumerate(("Net and", "w1", "网", None, "here"))], "deck int, slide_index int, title string, text string, low boolean")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sent, dealt = scores.slide_scores(s, p), scores.slide_scores(s, p, most_sent=0)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (sent, dealt)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    by_word = re.compile(r"hashpartitioning\(deck#\d+L?, (?:token|gram)#")
    assert [bool(by_word.search(x)) for x in plans] == [False, True]
    rows = [sorted(map(tuple, x.collect())) for x in (sent, dealt)]
    assert rows[0] == rows[1] and len(rows[0]) == 120
    assert {r[3] for r in rows[0] if r[6]} == {0, 1, 2, 5, 6, 7, 10, 11, 12}


def test_openings_of_equal_worth(spark):
    # 6 - 0.6 * 2 is 12 - 0.6 * 12; the smaller slide wins.
    assert [path.opening(n, 0)[0] for n in (1, 4, 7, 13)] == [0.0, -1.8, -3.6, -7.2]
    got = path.slide_paths(spark.createDataFrame([(1, 1, "segment_001", 13, 12.0, 1), (1, 1, "segment_001", 3, 6.0, 2)], "stream_id long, segment_number int, segment_id string, slide_index int, score double, rank int")).collect()
    assert {r["slide_index"]: (r["selected"], r["cumulative_score"], r["gap"]) for r in got} == {3: (True, 4.8, 0.0), 13: (False, 4.8, 0.0)}


def test_the_smaller_of_two_equal_slides_is_aligned(spark):
    # One word shared with slide 3, two with slide 13: 4.8 each with what the opening is worth.
    said = [(1, 0, 40, "about attention", "alpha beta")]
    assert aligned_one(spark, said, slides=[(3, "Third page", "alpha", False), (13, "Other page", "alpha beta", False)]) == [("ppt_slide_match", ["slide_003"], False, False)]


def test_a_section_is_named_after_the_smaller_of_two_equal_slides(spark):
    paths = path.slide_paths(spark.createDataFrame([(1, 1, "segment_001", 19, 18.0, 1), (1, 1, "segment_001", 9, 12.0, 2)], "stream_id long, segment_number int, segment_id string, slide_index int, score double, rank int"))
    titles = spark.createDataFrame([(9, "Ninth page"), (19, "Other page")], "slide_index int, title string")
    visual = F.array(F.struct(F.lit("").alias("id"), F.col("score"), F.lit(0.0).alias("ts"), F.col("title"), F.lit("").alias("ocr_text"), F.lit("").alias("relative_path")))
    aligned = paths.filter("selected").join(titles, "slide_index").select("stream_id", "segment_number", "segment_id", F.lit("").alias("summary"), F.lit("words").alias("text"), F.lit("").alias("cleaned_text"), F.lit(0.0).alias("start"), F.lit(40.0).alias("end"), visual.alias("selected_visuals"))
    assert structure.outline(aligned).first()["source_title"] == "Ninth page"


def test_gates(spark):
    r = one(spark, ok=gates.valid_correction(F.lit("a"), F.lit("b"), F.lit("c"), F.array(F.lit(" "), F.lit("x"))), no=gates.valid_correction(F.lit("a"), F.lit("b"), F.lit(" "), F.array(F.lit("x"))), n=gates.required_corrections(F.lit("x" * 200)), why=gates.note_reasons(F.lit("## 知识小结")), m=gates.note_reasons(F.lit(None).cast("string")), mode=align.source_mode(F.lit("slides-first"), F.lit(0), F.lit(True)))
    assert r["ok"] and not r["no"] and r["n"] == 3 and len(r["why"]) == 3 and r["m"] == ["note.md 不存在"] and r["mode"] == "video-first"


def test_stage_plan(spark):
    rows = [(1, s, True, s == "note") for s in gates.STAGES] + [(2, s, False, s == "transcribe") for s in gates.STAGES]
    got = {(r["stream_id"], r["stage"]): (r["run"], r["reason"]) for r in gates.stage_plan(spark.createDataFrame(rows, "stream_id long, stage string, ready boolean, forced boolean")).collect()}
    assert [s for s in gates.STAGES if got[1, s][0]] == ["note", "metadata"] and all(got[2, s][0] for s in gates.STAGES)
    assert {got[1, s][1] for s in gates.STAGES[:6]} == {"preserved for note-only rerender"}


def test_review_gate(spark):
    why = lambda **k: gates.review_reasons(*(k.get(n, F.lit(d)) for n, d in (("raw", "x" * 200), ("cleaned", "y"), ("status", "done"), ("updated", "now"))), k.get("missing", F.array().cast("array<string>")), k.get("n", F.lit(3)))
    r = one(spark, a=why(), b=why(cleaned=F.lit(None).cast("string")), c=why(n=F.lit(2), missing=F.array(F.lit("segment_002")), updated=F.lit(None).cast("string")), d=why(cleaned=F.lit("x" * 200)))
    assert r["a"] == [] and r["b"] == ["transcript.cleaned.txt 不存在"] and len(r["d"]) == 1
    assert r["c"] == ["last_updated 为空", "segment_reviews 未覆盖全部分段: segment_002", "有效纠错条目不足 3 条"]


def test_expected_frames(spark):
    r = one(spark, a=gates.expected_frames(F.lit(450.0), F.lit(60), F.lit(4)), b=gates.expected_frames(F.lit(100.0), F.lit(60), F.lit(4)), c=gates.expected_frames(F.lit(0.0), F.lit(60), F.lit(4)), d=gates.expected_frames(F.lit(120.0), F.lit(60), F.lit(4)))
    assert (r["a"], r["b"], r["c"], r["d"]) == (4, 3, 0, 2)


def test_repeated_titles():
    assert structure.without_repeats(["a", "a", "a", "b"], ["a", "c", "c", "b"]) == ["a", "c", "a", "b"]
    assert structure.without_repeats(["a", "a", "a"], ["a", "a", "a"]) == ["a", "a（续）", "a"]


def test_stamps_leave_the_lecture(spark):
    n = spark.createDataFrame([(1, "# T [00:01]\nx [00:09]\n## 课程讲义\n### h [00:02]\nx [00:03]\n- 1. a [00:05]\n| y [00:06] |\n![i](pipeline/a/b.png) [00:07]\n## 关键截图索引\ny [00:04]")], "stream_id long, markdown string")
    assert structure.without_body_stamps(n).first()["markdown"] == "# T [00:01]\nx [00:09]\n## 课程讲义\n### h [00:02]\nx\n- 1. a [00:05]\n| y [00:06] |\n![i](../a/b.png) [00:07]\n## 关键截图索引\ny [00:04]"


def test_asset_paths(spark):
    cases = [("pipeline/a/b.png", "../a/b.png"), ("./x//y/./z", "x/y/z"), ("/abs/p", "/abs/p"), ("https://h/p", "https://h/p"), ("pipeline", "pipeline"), ("  ", "")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "p string")
    assert [r["x"] for r in df.select(structure.asset_path(F.col("p")).alias("x")).collect()] == [b for _, b in cases]


def test_no_cross_product(spark):
    for name in ("near_matches", "slide_scores", "weighted_overlap_top1"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    r = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted([tuple(flat(x[c]) for c in cols) for x in df.collect()], key=repr) == sorted([tuple(flat(x[names.index(c)]) for c in cols) for x in r.fetchall()], key=repr)
