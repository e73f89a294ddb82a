import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import splitting
from inkstrata.llm.codepoints import flatten

SCHEMA = "id string, chapter_title string, text string, title string, piece int"


def split(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    return splitting.split_oversized(df, "id", "chapter_title", "text", **how).orderBy("id", "piece").collect()


def ends_of(text):
    """Boundaries by reading on, character by character."""
    found, i = set(), 0
    while i < len(text):
        if text[i] in splitting.MARKS:
            j = i + 1
            while j < len(text) and text[j] in splitting.CLOSERS:
                j += 1
            found.add(j)
        if text[i] == "\n" or text[i] == "\r" and text[i + 1 : i + 2] != "\n":
            found.add(i + 1)
        i += 1
    return found


def greedy(text, room, overlap):
    stops, at, out = ends_of(text), 0, []
    lap = min(overlap, room - 1)
    while at < len(text):
        start = max(0, at - lap) if at else 0
        reach = min(len(text), start + room)
        best = reach if reach == len(text) else max((b for b in stops if at < b <= reach), default=reach)
        out.append((start, best))
        at = best
    return out


TEXT = st.text("天地玄黄。」！；\n\r）(a", max_size=120)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(1, 30)), min_size=1, max_size=5), st.integers(0, 8))
def test_doubling_equals_the_greedy_cut(rows, overlap):
    points, offsets = flatten(pa.array([t for t, _ in rows]))
    flags = splitting.boundaries(points, offsets)
    for k, (text, _) in enumerate(rows):
        inner = {b for b in ends_of(text) if b < len(text)}
        assert {i for i in range(1, len(text)) if flags[offsets[k] + i]} == inner
    owner, ends = splitting.cuts(points, offsets, np.array([r for _, r in rows]), overlap, flags)
    for k, (text, room) in enumerate(rows):
        assert ends[owner == k].tolist() == [b for _, b in greedy(text, room, overlap)]


def test_pieces_cover_overlap_and_fit(spark):
    text = "天地玄黄，宇宙洪荒。" * 60
    found = split(spark, [("a", "章题", text)])
    assert all(len("章题") + len(r.text) <= 240 for r in found) and {r.kind for r in found} == {"natural"}
    for before, after in zip(found, found[1:]):
        assert after.text.startswith(before.text[-20:])
    assert found[0].text + "".join(r.text[20:] for r in found[1:]) == text
    assert all(r.text.endswith("。") for r in found)


def test_kinds_at_the_limit(spark):
    rows = [("fits", None, "天" * 239 + "。" + "地"), ("forced", None, "天" * 240 + "。" + "地"), ("title", "题", "天" * 239 + "。"), ("short", "题", "天" * 239), ("narrow", "题" * 300, "x"), ("brim", "题" * 239, "天。"), ("one", "题" * 239, "。。")]
    kinds = {r.id: r.kind for r in split(spark, rows)}
    assert kinds == {"fits": "natural", "forced": "forced", "title": "forced", "narrow": "forced", "brim": "forced", "one": "natural"}


def test_titles_without_room_nulls_repeats_and_long_texts(spark):
    rows = [("wide", "题" * 300, "天地"), ("none", "题" * 300, None), ("empty", "题" * 300, ""), (None, None, "天" * 300), ("twice", None, "天。" * 200), ("twice", None, "天。" * 200), ("long", None, "天" * 100_000)]
    found = split(spark, rows)
    assert [r.text for r in found if r.id == "wide"] == ["天", "地"]
    assert {r.id for r in found} == {"wide", "twice", "long", "empty"}
    assert [(r.kind, r.piece, r.start_at, r.end_at, r.text) for r in found if r.id == "empty"] == [("forced", 0, 0, 0, "")]
    assert len({r.piece for r in found if r.id == "twice"}) == sum(r.id == "twice" for r in found)
    assert split(spark, []) == []


def test_forced_cuts_spare_combining_marks(spark):
    for marks in (1, 30):
        text = ("e" + "\u0301" * marks) * 400
        found = split(spark, [("a", None, text)], overlap=0)
        assert "".join(r.text for r in found) == text and all(r.text.startswith("e") and len(r.text) <= 240 for r in found)
    only = split(spark, [("a", None, "e" + "\u0301" * 700)], overlap=0)  # one sequence longer than a piece
    assert [len(r.text) for r in only] == [240, 240, 221]
    text = "e\u0301" * 400
    assert all(not r.text.startswith("\u0301") for r in split(spark, [("a", None, text)], overlap=0))
