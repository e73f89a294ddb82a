import random

import numpy as np

from inkstrata.llm import spans

SCHEMA = "id string, book_id string, normalized_text string, key string, grp string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "x") for r in rows], SCHEMA)


def pairs(spark, rows, span=24):
    return {(r.id_a, r.id_b) for r in spans.shared_pairs(frame(spark, rows), "id", "book_id", "normalized_text", span).collect()}


def brute(rows, span):
    texts = {i: (b, t) for i, b, t in rows if i and b and t}
    parts = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, (b, t) in texts.items()}
    return {(a, b) for a in texts for b in texts if a < b and texts[a][0] != texts[b][0] and parts[a] & parts[b]}


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(k))
    shared = [text(rng.randrange(18, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        body = text(rng.randrange(0, 50)) + (rng.choice(shared) if rng.random() < 0.5 else "") + text(rng.randrange(0, 50))
        rows.append((f"p{i:03d}", f"b{rng.randrange(4)}", body))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    assert pairs(spark, rows) == brute(rows, 24) != set()


def test_odd_spans_and_exact_length(spark):
    rows = [("a", "x", "零" * 3 + "一二三四五六七"), ("b", "y", "一二三四五六七"), ("c", "z", "一二三四五六")]
    assert pairs(spark, rows, 7) == {("a", "b")}


def test_nulls_repeats_copies_and_empty_texts(spark):
    long = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [("a", "x", long), ("a", "x", long), ("b", "y", long), ("c", "x", long), ("d", None, long), (None, "z", long), ("e", "y", None), ("f", "y", "")]
    assert pairs(spark, rows) == {("a", "b"), ("b", "c")}
    assert pairs(spark, []) == set()


def test_repeats_within_a_record_or_a_book_are_not_shared(spark):
    part = "".join(chr(0x4E00 + i) for i in range(30))
    assert pairs(spark, [("a", "x", part * 2), ("b", "x", part)]) == set()


def test_periodic_texts(spark):
    rows = [("a", "x", "玉" * 100), ("b", "y", "玉" * 60), ("c", "z", "石" + "玉" * 24)]
    assert pairs(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_report_of_spans(spark):
    part = "".join(chr(0x4E00 + i) for i in range(30))
    rows = [("a", "x", "零零" + part + "一"), ("b", "y", part + "二"), ("c", "x", "无")]
    found = {r.id: r for r in spans.shared_spans(frame(spark, rows), "id", "book_id", "normalized_text").collect()}
    assert set(found) == {"a", "b"}
    assert [tuple(s) for s in found["a"].spans] == [(2, 32)] and found["a"].shared_chars == 30 and found["a"].total_chars == 33
    assert [tuple(s) for s in found["b"].spans] == [(0, 30)]


def test_rolling_hash_is_that_of_the_window():
    points = np.random.default_rng(1).integers(0, 0x110000, 500).astype(np.uint32)
    for width in (1, 2, 3, 12, 24, 37):
        whole = spans.rolling(points, width)
        assert len(whole) == 500 - width + 1
        assert all(whole[i] == spans.rolling(points[i : i + width], width)[0] for i in (0, 7, 500 - width))
    assert len(spans.rolling(points[:3], 4)) == 0


def test_one_window_in_a_hundred_thousand_texts(spark):
    window = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"[:24]
    df = spark.range(100_000).selectExpr("cast(id as string) id", "if(id % 50000 = 7, 'y', 'x') book_id", f"concat(md5(cast(id as string)), '{window}', md5(cast(-id as string))) normalized_text")
    found = spans.shared_pairs(df, "id", "book_id", "normalized_text")
    assert found.count() == 99_998 * 2
    assert spans.shared_windows(df, "id", "book_id", "normalized_text").where(f"key = '{window}'").count() == 100_000


def test_packed_hashes_come_back():
    rng = np.random.default_rng(2)
    for groups in (3, 1000, 70_000):
        hashes, names = rng.integers(0, 1 << 63, 200_000).astype(np.uint64), rng.integers(-(1 << 62), 1 << 62, groups)[rng.integers(0, groups, 200_000)]
        back = spans.unpacked_hashes(spans.packed_hashes(hashes, names))
        assert (back[0] == hashes).all() and (back[1] == names).all()
