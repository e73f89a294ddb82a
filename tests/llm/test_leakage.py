import random
import unicodedata

from inkstrata.llm import leakage

DOC = "doc_id long, text string, item_id long, start_at long"


def fold(text):
    return "".join(c.lower()[0] for c in text if unicodedata.category(c)[0] in "LN")


def run(spark, docs, items, least=40, **how):
    d = spark.createDataFrame([(i, t, 7, 7) for i, t in docs], DOC)
    e = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    return leakage.leaked(d, "doc_id", "text", e, "item_id", "text", least, **how).collect()


def brute(docs, items, least):
    grams = lambda t: {t[i : i + least] for i in range(len(t) - least + 1)}
    return {(d, i) for d, t in docs if t for i, q in items if q and grams(fold(t)) & grams(fold(q))}


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéfΣй中の3") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(3, 30))) for i in range(12)]
    docs = []
    for k in range(60):
        body = text(rng.randrange(0, 30))
        if rng.random() < 0.6:
            source = rng.choice(items)[1]
            a = rng.randrange(len(source))
            part = source[a : a + rng.randrange(5, 140)]
            body += " " + "".join(c.upper() + rng.choice(["", "-", "\n> ", ""]) for c in part)
        docs.append((k, body + text(rng.randrange(0, 9))))
    return docs, items


def test_pairs_equal_brute_force(spark):
    for least in (20, 41):
        docs, items = made(least)
        assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, least)} == brute(docs, items, least) != set()


def test_offsets_are_those_of_the_original(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    (row,) = run(spark, [(1, "… Intro! “" + item.upper().replace(" ", " — ") + "”, end")], [(5, item)])
    text = "… Intro! “" + item.upper().replace(" ", " — ") + "”, end"
    assert fold(text[row.start_at : row.end_at]) == fold(item) and text[row.start_at] == "A" and row.chars == len(fold(item))


def test_matches_do_not_cross_documents_and_short_items_give_nothing(spark):
    item = "abcdefghijklmnopqrstuvwxyz0123456789abcdefgh"
    assert run(spark, [(1, item[:22]), (2, item[22:])], [(5, item)]) == []
    assert run(spark, [(1, item)], [(5, item[:39])]) == []


def test_nulls_repeats_ties_and_empty_tables(spark):
    item = "abcdefghijklmnopqrstuvwxyz0123456789abcdefgh"
    found = run(spark, [(1, item), (2, None), (3, ""), (1, item)], [(5, item), (5, item), (6, item), (7, None), (None, item)])
    assert sorted({(r.doc_id, r.item_id) for r in found}) == [(1, 5), (1, 6)]
    assert run(spark, [], [(5, item)]) == [] == run(spark, [(1, item)], [])


def test_rounds_of_a_large_item_set_give_the_same(spark):
    docs, items = made(3)
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(run(spark, docs, items, 20)) == key(run(spark, docs, items, 20, automaton_chars=60))


def test_a_very_long_document(spark):
    item = "abcdefghijklmnopqrstuvwxyz0123456789abcdefgh"
    (row,) = run(spark, [(1, "x " * 300_000 + item)], [(5, item)])
    assert row.start_at == 600_000
