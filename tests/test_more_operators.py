"""Sources, sinks, image metrics and reviews that no registered query shows in full."""

import json

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import changes, gates, images, order, segments, structure
from tidemark.sinks import artifacts
from tidemark.sources import adapters, store


def parts(mask):
    """Sizes of connected parts, diagonals included, by a plain search."""
    left, sizes = set(zip(*map(list, np.nonzero(mask)), strict=True)), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            i, j = todo.pop()
            n += 1
            for x in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if x in left:
                    left.remove(x)
                    todo.append(x)
        sizes.append(n)
    return sorted(sizes)


def test_components():
    rng = np.random.default_rng(1)
    for density in (0.0, 0.1, 0.35, 0.6, 1.0):
        mask = rng.random((40, 60)) < density
        assert sorted(images.component_sizes(mask).tolist()) == parts(mask) if mask.any() else parts(mask) == []
    snake = np.zeros((41, 60), bool)
    snake[::2], snake[1::4, 59], snake[3::4, 0] = True, True, True
    assert images.component_sizes(snake).tolist() == [int(snake.sum())]


def test_change_metrics(spark):
    dark = np.zeros((360, 640), np.uint8)
    light = dark.copy()
    light[100:200, 100:200] = 200
    rows = [(1, i, float(i), x.tobytes(), 360, 640) for i, x in enumerate([dark, dark, light])]
    got = images.with_change_metrics(spark.createDataFrame(rows, "stream_id long, event_id long, ts double, image binary, height int, width int")).orderBy("ts").collect()
    assert [r["change_ratio"] for r in got[:2]] == [0.0, 0.0] and [r["component_count"] for r in got] == [0.0, 0.0, 1.0]
    assert abs(got[2]["change_ratio"] - 2500 / 57600) < 0.01 and got[2]["change_ratio"] == got[2]["component_ratio"] and got[2]["scene_score"] > 5
    masked = images.analysis_frame(np.full((360, 640), 99, np.uint8))
    assert masked[0].max() == 0 and masked[-1].max() == 0 and masked[-40, -1] == 0 and masked[90, 160] == 99


def test_reviews_by_place_and_last(spark):
    s = spark.createDataFrame([(1, 1, "segment_001", "x"), (1, 2, "segment_002", "y"), (1, 3, "segment_003", "z")], "stream_id long, segment_number int, segment_id string, text string")
    lines = spark.createDataFrame([(1, [" a ", " ", "c", "d"])], "stream_id long, lines array<string>")
    assert sorted((r["segment_number"], r["cleaned_text"]) for r in gates.cleaned_by_place(s, lines).collect()) == [(1, "a"), (3, "c")]
    reviews = spark.createDataFrame([(1, 1, "old", [], "done", 1), (1, 1, "new", ["i"], "done", 2)], "stream_id long, segment_number int, summary string, issues array<string>, status string, at int")
    assert [(r["summary"], r["status"]) for r in gates.last_reviews(s, reviews).orderBy("segment_number").collect()] == [("new", "done"), ("", ""), ("", "")]


def test_final_reasons(spark):
    rows = spark.createDataFrame([(1, 2, "segment_002", ["b"]), (1, 1, "segment_001", ["a", "b"])], "stream_id long, segment_number int, segment_id string, reasons array<string>")
    joined = gates.final_reasons(rows).select(gates.all_reasons(F.array(F.lit("segment_001: a"), F.lit("whole")), F.col("segment_reasons")).alias("f"), gates.all_reasons(F.array().cast("array<string>"), F.col("segment_reasons")).alias("p")).first()
    assert joined["f"] == ["segment_001: a", "segment_001: b", "segment_002: b", "whole"] and joined["p"] == []


def test_refreshed_units(spark):
    schema = "stream_id long, event_id long, ts double, change_ratio double, component_ratio double, scene_score double, phash string, ocr_text string, candidate boolean, change_kind string"
    frames = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, "a" * 16, "many recognised words of a good page", False, "no_change"), (1, 1, 100.0, 0.0, 0.0, 0.0, "b" * 16, "x", False, "no_change")], schema)
    asked = []

    def recognise(points):
        asked.extend(sorted(r["at"] for r in points.collect()))
        return spark.createDataFrame([(1, 9, 112.0, 0.0, 0.0, 0.0, "c" * 16, "a page that was found on the second look", False, "no_change")], schema)

    got = changes.refreshed_units(frames, spark.createDataFrame([(1, 200.0)], "stream_id long, duration double"), recognise).orderBy("unit_number").collect()
    assert asked == [88, 112] and [(r["ts"], r["low"]) for r in got] == [(0.0, False), (100.0, True), (112.0, False)]


def test_related_frames_take_both_ends(spark):
    s = spark.createDataFrame([(1, 1, 10.0, 20.0)], "stream_id long, segment_number int, start double, end double")
    f = spark.createDataFrame([(1, float(t)) for t in (4, 5, 25, 26)], "stream_id long, ts double")
    assert sorted(r["ts"] for r in segments.related_frames(s, f).collect()) == [5.0, 25.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n one \n\ntwo\nthree\n")
    assert [tuple(r) for r in adapters.head_lines(spark, str(tmp_path / "a.txt"), 2).collect()] == [("a", ["one", "two"])]
    assert adapters.explicit_path(spark, None) is None and adapters.explicit_path(spark, str(tmp_path / "none")) is None
    assert adapters.explicit_path(spark, str(tmp_path / "a.txt")) == str(tmp_path / "a.txt")
    for n in ("frame_002.jpg", "frame_001.jpg", "x.png"):
        (tmp_path / n).write_bytes(b"i")
    assert [(r["name"], r["n"], r["ts"]) for r in adapters.frame_files(spark, str(tmp_path)).orderBy("n").collect()] == [("frame_001.jpg", 1, 0.0), ("frame_002.jpg", 2, 0.0)]
    numbered = adapters.numbered_frames(spark.createDataFrame([(1, 7)], "stream_id long, n int"), spark.createDataFrame([(1, 49), (1, 25), (2, 3)], "stream_id long, at long"))
    assert sorted(map(tuple, numbered.collect())) == [(1, 25, 8), (1, 49, 9), (2, 3, 1)]
    assert spark.range(1).select(adapters.preferred(F.lit(" "), F.lit("raw")).alias("x")).first()["x"] == "raw"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "stream_id long, v string, n int")
    folder = artifacts.write_json(rows, str(tmp_path), "visual_units_json")
    artifacts.write_json(rows.filter("stream_id = 2").withColumn("v", F.lit("c")), str(tmp_path), "visual_units_json")
    got = sorted((json.loads(p.read_text())["v"], p.parent.name) for p in (tmp_path / "visual_units_json").rglob("part-*"))
    assert got == [("a", "stream_id=1"), ("c", "stream_id=2")] and folder.endswith("visual_units_json")
    artifacts.write_text(spark.createDataFrame([(5, "# T\nx")], "stream_id long, markdown string"), str(tmp_path), "note_path")
    assert [p.read_text() for p in (tmp_path / "note_path").rglob("part-*")] == ["# T\nx\n"]
    r = spark.range(1).select(artifacts.artifact_path("/out/", F.lit("/v/4.1BERT-2训练.mp4"), "note_path").alias("p"), artifacts.relative_path(F.lit("/w/a/b"), F.lit("/w/")).alias("i"), artifacts.relative_path(F.lit("/wa/b"), F.lit("/w")).alias("o")).first()
    assert tuple(r) == ("/out/4-1bert-2训练/pipeline/05_note/note.md", "a/b", "/wa/b")
    assert spark.range(1).select(artifacts.now_label().alias("t")).first()["t"][10] == "T"


def test_store_refuses_a_folder_of_its_own_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    try:
        store.shared_folder(Session)
    except ValueError:
        return
    raise AssertionError("a cluster needs spark.checkpoint.dir")


def test_first_full_source(spark):
    a, b = (spark.createDataFrame(r, "stream_id long, v string") for r in ([(1, "a")], [(1, "b"), (2, "b")]))
    assert sorted(map(tuple, adapters.first_full(a, b).collect())) == [(1, "a"), (2, "b")]


def test_previous_rows_across_ranges(spark):
    rows = [(k, i, i * 10) for k, step in (("a", 1), ("b", 7), (None, 3)) for i in range(0, 50, step)]
    got = order.with_previous(spark.createDataFrame(rows, "k string, i int, v int"), "k", "i", "v", "p", width=4).collect()
    want = {(k, i): None if i == 0 else (i - step) * 10 for k, step in (("a", 1), ("b", 7), (None, 3)) for i in range(0, 50, step)}
    assert {(r["k"], r["i"]): r["p"] for r in got} == want and len(got) == len(rows)


#: Fixed value: the note of one section, as it is laid out.
NOTE = """# 1.2-注意力 学习讲义

> 来源视频：`a.mp4` | 视频时长：`00:01:30` | 小节数：`1` | 关键纠错：`2`

## 课程目录

### 一、注意力 00:00:05

1. ATTENTION HEADS [00:05]

## 知识小结

| 时间 | 小节 | 核心内容 | 易错点 | 难度 |
| --- | --- | --- | --- | --- |
| [00:05] | ATTENTION HEADS | 本段讲解了注意力机制的计算步骤 | - | 高 |

## 课程讲义

### 一、注意力 00:00:05

#### 1. ATTENTION HEADS [00:05]

1）核心定义卡片
> 概念：ATTENTION HEADS
> 定义：注意力机制的计算步骤

2）知识框架
- 注意力机制的计算步骤
- 注意力机制先计算相似度
- 然后做归一化处理得到权重

3）公式与板书
- expression_1: `$y = Wx + b$`

4）讲解展开
- 注意力机制先计算相似度
- 然后做归一化处理得到权重

5）配图与板书

![00:00:05](../03_alignment/s.png)


## 关键截图索引

### 00:00:30

![00:00:30](../01_media/f.jpg)
"""


def test_note(spark):
    visual = "array<struct<id:string,score:double,ts:double,title:string,ocr_text:string,relative_path:string>>"
    aligned = spark.createDataFrame([(1, 1, "segment_001", 5.0, 65.0, "本段讲解了注意力机制的计算步骤", ["a"], "注意力机制先计算相似度。然后做归一化处理得到权重。", "raw", "ppt_slide_match", [("slide_002", 1.0, 5.0, "Attention Heads", "y = Wx + b", "pipeline/03_alignment/s.png")])], f"stream_id long, segment_number int, segment_id string, start double, end double, summary string, issues array<string>, cleaned_text string, text string, mode string, selected_visuals {visual}")
    found = structure.blocks(aligned, structure.outline(aligned))
    streams = spark.createDataFrame([(1, "1.2-注意力", "a.mp4", 90.0, ["x"]), (2, "no segments", "b.mp4", 5.0, ["first line"])], "stream_id long, title string, source string, duration double, excerpt array<string>")
    frames = spark.createDataFrame([(1, 30.0, 3, "pipeline/01_media/f.jpg")], "stream_id long, ts double, event_id long, relative_path string")
    notes = {r["stream_id"]: r["markdown"] for r in structure.without_body_stamps(structure.note(found, streams, frames, spark.createDataFrame([(1, 2)], "stream_id long, n long"))).collect()}
    assert notes[1] == NOTE
    assert "- first line" in notes[2] and "- 未生成知识小结" in notes[2] and "- 未生成关键截图" in notes[2]
