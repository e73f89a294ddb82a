import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import lookalikes as L

SCHEMA = "id string, text string, normalized_text string, form string, look string, stored string"
ALIKE = [
    ("ｐｉｎ ２３", "pin 23"), ("nǎ", "nǎ"), ("a b　c d", "a b c d"), ("玉​石﻿­", "玉石"), ("рaper", "paper"), ("Ε-3", "E-3"),
    ("⽽后", "而后"), ("者", "者"), ("二八", "ニハ"), ("⻅马", "见⻢"), ("ɡǎn", "gǎn"), ("止｡", "止。"), ("ǚ", "ǚ"),
]
UNLIKE = [("ná", "nà"), ("玉", "王"), ("見", "见"), ("a b", "ab"), ("a\nb", "a b"), ("já", "jā"), ("己", "已"), ("B", "b"), ("a  b", "a b"), ("。", ".")]


@pytest.mark.parametrize("a,b", ALIKE)
def test_what_looks_alike(a, b):
    for words in ([], [(a, 3), (b, 2)], [(b, 9), (a, 1)]):
        canon = L.Canon(words)
        assert canon.form(a) == canon.form(b)


@pytest.mark.parametrize("a,b", UNLIKE)
def test_what_does_not(a, b):
    canon = L.Canon([(a, 3), (b, 2)])
    assert canon.form(a) != canon.form(b)


def test_the_most_frequent_spelling_is_canonical():
    canon = L.Canon([("рука", 5), ("pyка", 1), ("paper", 9), ("рaрer", 2)])
    assert canon.form("pyка") == "рука" and canon.form("рaрer, pa​per") == "paper, paper"
    assert canon.form("ｘｙｚ") == "xyz" == L.Canon([("ｘｙｚ", 3)]).form("x​yz")


def test_the_automaton_counts_other_edits():
    trie = L.Trie()
    for word, n in (("paper", 5), ("pepper", 9), ("papers", 1)):
        trie.add(word, n)
    assert trie.match("рaper") == ("paper", 0) and trie.match("papper") is None
    assert trie.match("papper", most=1) == ("pepper", 1) and trie.match("pape", most=1) == ("paper", 1)
    assert trie.match("zzzz", most=2) is None


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return {tuple(r) for r in L.lookalike_pairs(df, "id", "text", "normalized_text").collect()}


def test_pairs(spark):
    rows = [("a", "玉 pin", "玉"), ("b", "玉 рin", "玉"), ("c", "玉 pin", "玉"), ("d", "玉 pin", "玉​"), ("e", "玉 pín", "玉"), ("f", "玉 pin", None), ("a", "玉 pin", "玉"), ("g", None, "玉"), (None, "玉 pin", "石"), ("h", "", None), ("i", "​", None)]
    same = {("a", "c")}
    assert pairs(spark, rows) == set(itertools.combinations("abcdf", 2)) - same | {("h", "i")}
    assert pairs(spark, []) == set()


def test_a_group_of_copies_forms_no_pairs(spark):
    rows = [(f"{i:04d}", "玉石", "玉石") for i in range(400)] + [("x", "玉‍石", "玉石")]
    assert pairs(spark, rows) == {(f"{i:04d}", "x") for i in range(400)}


def test_canonical_columns(spark):
    df = spark.createDataFrame([("a", "玉　рin", None, "x", "y", "z"), ("b", "玉 pin" * 5000, "ｐ", "x", "y", "z")], SCHEMA)
    found = {r.id: r for r in L.canonical(df, ["id"], ["text", "normalized_text"]).collect()}
    assert found["a"].text_form == "玉 pin" and found["a"].normalized_text_form is None and found["b"].normalized_text_form == "p"
    assert found["b"].text_form == "玉 pin" * 5000


def test_the_states_are_all_entries_that_look_alike():
    trie = L.Trie()
    for word, n in (("рука", 5), ("pука", 2), ("pyka", 4)):  # the same to the eye but for the k
        trie.add(word, n)
    assert trie.match("ру\u200bка") == ("рука", 0) and trie.match("pyкa") == ("рука", 0)
    node = trie.root
    assert len(node.children) == 2 and [len(x) for x in node.alike.values()] == [2]
    trie.add("руx", 9)
    assert trie.match("pyк") is None and trie.match("pyx") == ("руx", 0)


def test_invisible_characters_of_an_entry_cost_nothing():
    trie = L.Trie()
    trie.add("a\u200db", 1)
    assert trie.match("ab") == ("a\u200db", 0) and trie.match("a\u2060b") == ("a\u200db", 0) and trie.match("b") is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aаbЬeé\u0301\u200bＡAΑ1k", min_size=1, max_size=5), min_size=1, max_size=12, unique=True), st.text("aаbЬeé\u0301\u200bＡAΑ1k", max_size=6), st.integers(0, 2))
def test_the_automaton_equals_edit_distance_of_looks(words, token, most):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
        return row[-1]

    trie = L.Trie()
    for word in words:
        trie.add(word, 1)
    found = trie.match(token, most)
    best = min(distance(L.skeleton(token), L.skeleton(w)) for w in words)
    assert (found and found[1]) == (best if best <= most else None)


def test_classes_count_what_pairs_would(spark):
    rows = [(f"{i:03d}", "玉石", "玉石") for i in range(40)] + [("x", "玉‍石", "玉石"), ("y", "玉石", None), ("z", "石", "石"), (None, "玉石", "玉"), ("n", None, "玉")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = {r.id: (r.class_id, r.members, r.links) for r in L.lookalike_classes(df, "id", "text", "normalized_text").collect()}
    assert found["000"] == ("000", 42, 2) and found["x"] == ("000", 42, 41) and found["z"] == ("z", 1, 0) and len(found) == 43
    assert sum(n for _, _, n in found.values()) == 2 * len(pairs(spark, rows))
