import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm.sentences import sentence_spans, sentences

CASES = {
    "abbreviations": ["Dr. Ana met Prof. O. B. Lin (cf. Wu, vol. 3, p. 17).", "She left, i.e. she ran, ca. 40 times.", "We saw scrolls, seals, etc.", "Then it rained."],
    "numbers and addresses": ["It is 3.14 wide, see www.a.example/b.v1.2 for Q.34.c, page 2.", "Next!"],
    "quotations": ["“Does it hold? It must!” asked Ann near the wall.", "He wrote: “One came. Two left.”", "Ben slept."],
    "brackets": ["(It was late. No one came.)", "He (or she?) stayed.", "Fine?!", "Yes..."],
    "ellipsis": ["She waited ... and waited … for it; still: nothing."],
    "german": ["Am 8. Oktober kam, z. B. in Bd. 2, S. 137, Prof. Weiß.", "Er schrieb: „Sie kommt. Sie geht.“", "Rund 6.304 Zeichen, d. h. viele."],
    "french": ["M. Dupont écrit : « Elle part. Elle revient ! »", "Pourquoi ?", "Voir p. ex. chap. 3, éd. Noir."],
    "hindi": ["डॉ. क. की सूची 4.1 सेमी है।", "“नाम है। पाठ है।”", "क्यों?"],
}


@pytest.mark.parametrize("name", CASES)
def test_sentences_of_alphabetic_scripts(name):
    text = " ".join(CASES[name])
    assert [text[a:b] for a, b in sentence_spans(text)] == CASES[name]


@pytest.mark.parametrize(
    "parts",
    [
        ["令儀孔昭。", "令其儀！？", "如玉如圭；如金……如石。"],
        ["曰：「作者其谁？吾不知。」", "又云『可』也。", "（此处有误。未详。）", "终。"],
        ["用例には「玉である。石だ。」と記している。", "第24.3節の語釈（No. 3）を改めている。", "『景』であるか？"],
        ["引「何也？」，而去。", "止"],
        ["ชื่ออธิบายสำเนา", " บัญชีอ้างถึง 4.9 หมายเหตุ", " ต้นฉบับ"],
    ],
)
def test_sentences_of_other_scripts(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == [p.strip() for p in parts]


def test_paragraphs():
    text = "A title\n\nOne line\n> goes on. And\n  ends.\n 　\n無標點之文\r\n\r\n終"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["A title", "One line\n> goes on.", "And\n  ends.", "無標點之文", "終"]


def test_an_unclosed_quotation_holds_nothing_back():
    text = "He said “yes. Then he left. “Well."
    assert len(sentence_spans(text)) == 3


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aB1 .!?。「」“”„()（）\n\t　 >,ท๑ कहा।etc"), max_size=80))
def test_spans_cover_everything_but_white_space(text):
    spans = sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())


def test_rows(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (3, " \n", 0), (4, "", 0), (1, "One. Two.", 0), (5, "字。" * 20_000, 0)], "doc_id long, text string, start_at int")
    found = [tuple(r) for r in sentences(df, "doc_id", "text").collect()]
    assert sorted(r for r in found if r[0] == 1) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sum(r[0] == 5 for r in found) == 20_000 and {r[0] for r in found} == {1, 5}
    assert sentences(df.limit(0), "doc_id", "text").collect() == []


@pytest.mark.parametrize("stray", ["( ( (", "( « ( «", "„ ( ( ("])
def test_stray_opening_signs_do_not_hide_a_partner(stray):
    parts = [f"“It {stray} was late. No one came.”", "Ben slept."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


@pytest.mark.parametrize("text,count", [
    ('He said "Stop. Go home." and left.', 1), ("He said ‹Stop. Go.› and left. Then he came.", 2), ("He said 'Stop. Go home.' and left. It's John's. So be it.", 3),
    ('他说"走吧。再见。"然后走了。好。', 3), ("(a [b {c 「d 『e 《f. g.》 h.』 i.」 j.} k.] l.) End. Next.", 3),
    ("This is modern art. We liked it.", 2), ("He said no. Then he left.", 2), ("Close the tab. Open it again.", 2), ("Il a vu le col. Puis il part.", 2), ("He got a B. Then he left.", 2), ("We met in Oct. It rained.", 2),
    ("See z. B. Die Lieder an. Das ist gut.", 2), ("M. Le Gall est venu. Il part.", 2), ("The text of no. 5 is lost. See fig. 3 and p. 4.", 2), ("Siehe Tab. 3 und die Abb. Linien.", 1), ("John B. Smith came. He left.", 2), ("Vgl. Die Lieder, S. 4.", 1),
    ("Items: 1. Foo 2. Bar. Next one.", 2), ("1. One thing. 2. Another. (a) Third.", 3), ("first\n2. Foo bar.\n3. Baz.", 2), ('1. "open one. Two.\n2. Three" four. Five.', 4),
])
def test_contexts_of_quotes_abbreviations_and_lists(text, count):
    assert len(sentence_spans(text)) == count, [text[a:b] for a, b in sentence_spans(text)]
