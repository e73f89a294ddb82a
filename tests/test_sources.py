import json

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import jsontext
from inkstrata.functions import text as T
from inkstrata.sources import importers, sinks

ALIASES = ("儀書", "仪书")


def works(spark, reader, *contents, **how):
    df = spark.createDataFrame([(f"b{i}", c if isinstance(c, str) else json.dumps(c, ensure_ascii=False)) for i, c in enumerate(contents)], "book_id string, content string")
    return reader(df, **how)


def test_shapes_of_anthologies(spark):
    found = works(
        spark,
        importers.anthology_works,
        [{"title": "关雎", "chapter": "国风", "section": "周南", "content": ["关关雎鸠，", " "]}],
        [{"chapter": "学而", "paragraphs": ["学而时习之"]}, {"chapter": "为政", "paragraphs": []}],
        [{"rhythmic": "浣溪沙", "author": "晏殊", "paragraphs": ["一曲新词"]}, {"title": "无题", "paragraphs": ["相见"]}],
        {"chapter": "大学", "paragraphs": ["大学之道"]},
        {"content": [{"title": "卷一", "content": [{"chapter": "甲", "paragraphs": ["乙。"]}]}, {"content": [{"title": "丙", "paragraphs": ["丁。"]}]}]},
    )
    got = {(r.book_id, r.n): (r.title, r.chapter_title, r.segments) for r in found.collect()}
    assert got == {
        ("b0", 0): ("关雎", "国风·周南", ["关关雎鸠，"]),
        ("b1", 0): ("学而", "学而", ["学而时习之"]), ("b1", 1): ("为政", "为政", []),
        ("b2", 0): ("浣溪沙", "晏殊·浣溪沙", ["一曲新词"]), ("b2", 1): ("无题", "无题", ["相见"]),
        ("b3", 0): ("大学", "大学", ["大学之道"]),
        ("b4", 0): ("甲", "卷一", ["乙。"]), ("b4", 1): ("丙", "选篇", ["丁。"]),
    }


@pytest.mark.parametrize("bad", [[{"foo": 1}], {"foo": []}, [{"title": "x", "content": ["y"]}, {"author": "z"}], "nonsense"])
def test_unknown_shapes_raise(spark, bad):
    with pytest.raises(Exception, match="unknown source structure"):
        works(spark, importers.anthology_works, bad).collect()


def test_passages_are_numbered(spark):
    w = works(spark, importers.anthology_works, [{"title": "甲", "content": ["令儀。！玉。", "石。"]}, {"title": "乙", "chapter": "甲", "content": ["金。"]}, {"title": "丙", "content": ["木。"]}])
    rows = sorted(importers.passages(w, ALIASES, "https://s", "https://v").collect(), key=lambda r: r.ord)
    assert [(r.id, r.chapter_id[-4:], r.ord, r.normalized_text) for r in rows] == [
        ("b0/work-0001/passage-0001", "0001", 1, "令仪"), ("b0/work-0001/passage-0002", "0001", 2, "玉"), ("b0/work-0001/passage-0003", "0001", 3, "石"),
        ("b0/work-0002/passage-0001", "0001", 4, "金"), ("b0/work-0003/passage-0001", "0002", 5, "木"),
    ]


def test_lines(spark):
    row = {"id": "x", "series": "s", "text": "玉。"}
    found = works(spark, importers.line_works, json.dumps(row) + "\r\n\n" + json.dumps(row | {"id": "y"}))
    assert [(r.n, r.title, r.segments) for r in found.orderBy("n").collect()] == [(0, "x", ["玉。"]), (1, "y", ["玉。"])]
    for bad, said in (('{"id": 1}\n', "line 1 is not valid"), (json.dumps(row) + "\nxx", "line 2 is not valid"), ("\n \n", "no text")):
        with pytest.raises(Exception, match=said):
            works(spark, importers.line_works, bad).collect()


OUTLINE = "#+TITLE: x\n序言。\n** 1 卷一\n天地\n 玄黄。\n*** 甲\n令儀。\n*** 乙\nabc\n** 卷二\n终。"


def test_outlines(spark):
    found = works(spark, importers.outline_works, OUTLINE, aliases=ALIASES).orderBy("n").collect()
    assert [(r.title, r.chapter_title, r.segments[0]) for r in found] == [("b0", "b0", "序言。"), ("卷一", "卷一", "天地玄黄。"), ("甲", "卷一", "令儀。"), ("卷二", "卷二", "终。")]
    (one,) = works(spark, importers.outline_works, OUTLINE, aliases=ALIASES, section="卷").collect()
    assert one.title == "卷一"


def test_chunks(spark):
    def cut(text, most):
        return spark.createDataFrame([(text,)], "t string").select(T.chunks(F.col("t"), *ALIASES, most)).first()[0]

    assert cut("天地玄黄。宇宙洪荒。日月盈昃。", 8) == ["天地玄黄。宇宙洪荒。", "日月盈昃。"]
    assert cut("", 8) == [] and cut("abc。", 8) == []
    long = "".join(chr(0x4E00 + i) for i in range(20))
    assert cut(long, 8) == [long[0:8], long[7:15], long[14:20]]
    assert cut(long[:8] + "，", 8) == [long[:8] + "，"]
    assert cut(long[:9] + "，，", 8) == [long[0:8], long[7:9] + "，，"]


def test_files_and_locks(spark, tmp_path):
    for name, text in (("b.txt", "乙"), ("a.txt", "甲"), ("c.md", "丙")):
        (tmp_path / name).write_text(text)
    joined = importers.joined_parts(importers.whole_files(spark, str(tmp_path)), r"\.txt$").first()[0]
    assert [line for line in joined.split("\n") if not line.startswith("**")] == ["甲", "乙"]
    found = importers.checksums(spark, str(tmp_path))
    assert importers.unlocked(found, found).count() == 0
    lock = found.where("path not like '%a.txt'").withColumn("sha256", F.when(F.col("path").like("%b.txt"), "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("gone", "1")], "path string, sha256 string"))
    assert {r.reason for r in importers.unlocked(found, lock).collect()} == {"not locked", "changed", "missing"}


def test_packing_is_next_fit(spark, tmp_path):
    rows = [(b, i, "x" * n) for b in ("p", "q") for i, n in enumerate((40, 40, 90, 5, 5, 200, 1))]
    df = spark.createDataFrame(rows, "book_id string, ord int, text string")
    found = sinks.packed(df, "book_id", ["ord"], 150).orderBy("book_id", "ord").collect()
    want, used, part = {}, 0, 0
    for r in [r for r in found if r.book_id == "p"]:
        if used and used + r.bytes + 1 > 150:
            used, part = 0, part + 1
        used += r.bytes + 1
        want[r.ord] = part
    assert {(r.book_id, r.ord): r.part for r in found} == {(b, o): p for b in ("p", "q") for o, p in want.items()}


def test_index_shards_are_read_by_bucket(spark, tmp_path):
    posts = spark.createDataFrame([("景", "p1", [0]), ("玉", "p1", [1]), ("a", "p2", [3])], "unit string, id string, positions array<int>")
    sinks.write_index(posts, str(tmp_path / "index"))
    found = sinks.read_units(spark, str(tmp_path / "index"), ["景"])
    assert [r.id for r in found.collect()] == ["p1"]
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_gates_and_publication(spark, tmp_path):
    artifacts = spark.createDataFrame([("a", "x" * 10), ("b", "x" * 30)], "name string, content string")
    assert [r.name for r in sinks.too_large(artifacts, {"b": 40}, 5).collect()] == ["a"]
    to = tmp_path / "out" / "r.json"
    sinks.publish_json(spark, str(to), {"n": 1}, lambda v: v if v["n"] else 1 / 0)
    sinks.publish_json(spark, str(to), {"n": 2}, lambda v: v)
    assert json.loads(to.read_text()) == {"n": 2}
    with pytest.raises(ZeroDivisionError):
        sinks.publish_json(spark, str(to), {"n": 0}, lambda v: v if v["n"] else 1 / 0)
    with pytest.raises(ValueError):
        sinks.publish_json(spark, str(to), {"n": "sk-" + "a" * 20}, lambda v: v)
    assert json.loads(to.read_text()) == {"n": 2} and not [p for p in to.parent.iterdir() if p.suffix == ".tmp"]


def test_json_functions(spark):
    texts = ['{"b":1,"a":{"d":[{"z":1,"y":2}],"c":"é"}}', '{"a":[1,"}"]} trailing', "[1", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", jsontext.stable_json("t").alias("s"), jsontext.first_value("t").alias("f")).orderBy("i").collect()
    assert rows[0].s == rows[0].f == '{"a":{"c":"é","d":[{"y":2,"z":1}]},"b":1}'
    assert rows[1].s is None and rows[1].f == '{"a":[1,"}"]}' and rows[2].f is None and rows[3].f is None
    shown = df.select(jsontext.redacted(F.lit("key sk-" + "a" * 12 + " and bearer abc"))).first()[0]
    assert shown == "key [REDACTED] and Bearer [REDACTED]"
