"""Mining of unit pairs and windows from texts: scoring, best evidence, quotas, interleaving, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T

from .numbering import place_within

#: Characters no pair is made of, and what a window must not hold.
FUNCTION_CHARACTERS = "在之兮者也矣于於以而与與为為乃则則曰何所且将將公君我你"
HARD_NEGATIVE = "死丧喪墓葬尸鬼刑杀殺戮辱贱賤凶灾災祸禍病疫殇殤"
WINDOW_NEGATIVE = HARD_NEGATIVE + "踯躅愁悲哀怨恨泣泪淚苦忧憂患"
#: The same two for names that are shown on their own, which have lists of their own.
SCREEN_FUNCTION = "不无無未莫其之兮者也矣于於以而与與為为乃则則曰何所且将將公君我你今昔日中上下来去入出有又正曾"
SCREEN_NEGATIVE = "墓葬死喪丧兵刑殺杀哀殤殇諷讽貶贬譏讥愁恨淚泪病苦怨孤寡鬼尸血災灾禍祸敗败辱賤贱惡恶凶"
WARFARE = "兵战戰伐攻败敗虏虜斩斬围圍"
NEAR = 4


def lexicon(candidates: DataFrame) -> DataFrame:
    """Units with scores, from the candidates whose names are made of them: ``unit, category, feminine, rarity, usability, family``."""
    category = F.when(F.col("at") == 0, F.col("first_category")).otherwise(F.col("second_category"))
    rows = candidates.select(F.posexplode(T.characters(F.col("given_name"))).alias("at", "unit"), "first_category", "second_category", "feminine", "rarity", "usability", "family_score")
    most = lambda c: F.coalesce(F.max(c), F.lit(0.0)).alias(c)
    scored = rows.groupBy("unit").agg(F.min(category).alias("category"), most("feminine"), most("rarity"), most("usability"), F.coalesce((F.max("family_score") >= 4.5).cast("int"), F.lit(0)).alias("family"))
    return scored


def _neighbours(passages: DataFrame, raw: str, normal: str, reach: int) -> DataFrame:
    """``id, i, unit, raw_at`` with arrays of the next ``reach`` units: made in the row of the passage, without a join or a window."""
    chars = T.characters(T.simplified(F.col("text"), raw, normal))
    units = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("unit"), i.alias("at"))), lambda x: x.unit.rlike(f"[{T.HAN_RANGES}]"))
    rows = passages.withColumn("units", units)
    return rows.select("*", F.posexplode("units").alias("i", "first")).withColumn("following", F.slice("units", F.col("i") + 2, F.lit(reach))).drop("units")


def pairs(passages: DataFrame, books: DataFrame, units: DataFrame, aliases: tuple[str, str]) -> DataFrame:
    """Every pair of lexicon units that stand next to or near each other, with grade, score and evidence.

    In a punctuated book raw neighbours are A and units 2 to 4 places apart B; in others only neighbours count, as B. Units that
    are neighbours but for punctuation between them are no pair.
    """
    shelf = books.where("source is not null").select(F.col("id").alias("book_id"), "title", F.col("category").alias("book_category"), "priority", F.coalesce(F.col("source.segmentation") == "punctuated", F.lit(False)).alias("punctuated"))
    near = _neighbours(passages.select("id", "book_id", "text", "normalized_text"), *aliases, NEAR).join(shelf, "book_id")
    near = near.select("id", "book_id", "title", "book_category", "priority", "punctuated", T.mining_penalty(F.col("text"), F.coalesce("normalized_text", F.lit(""))).alias("penalty"), F.col("first.unit").alias("u1"), F.col("first.at").alias("a1"), F.posexplode("following").alias("gap", "second"))
    near = near.select("*", F.col("second.unit").alias("u2"), F.col("second.at").alias("a2")).where((F.col("gap") == 0) & (F.col("a2") == F.col("a1") + 1) | (F.col("gap") > 0) & F.col("punctuated"))
    named = lambda n: units.select(F.col("unit").alias(f"u{n}"), F.col("category").alias(f"category{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("feminine", "rarity", "usability", "family")])
    both = near.drop("second").join(named(1), "u1").join(named(2), "u2")
    grade = F.when((F.col("gap") == 0) & F.col("punctuated"), "A").otherwise("B")
    mean = lambda c: (F.col(f"{c}1") + F.col(f"{c}2")) / 2
    family = F.col("family1") + F.col("family2")
    score = F.when(grade == "A", 10000).otherwise(0) + mean("feminine") * 120 + mean("usability") * 90 + mean("rarity") * 45 + family * 80 + (4 - F.col("priority")) * 60 - F.col("penalty")
    return both.select(F.concat("u1", "u2").alias("name"), grade.alias("grade"), "id", "book_id", "title", "book_category", (F.col("gap") + 1).alias("distance"), score.alias("score"), mean("feminine").alias("feminine"), mean("rarity").alias("rarity"), mean("usability").alias("usability"), family.alias("family"), "category1", "category2")


def best_evidence(found: DataFrame) -> DataFrame:
    """The best row of each name: greatest score, then smallest passage id, then smallest distance; combined before the shuffle."""
    rest = [c for c in found.columns if c not in ("name", "score", "id", "distance")]
    key = F.struct((-F.col("score")).alias("s"), "id", "distance", *rest)
    return found.groupBy("name").agg(F.min(key).alias("k")).select("name", (-F.col("k.s")).alias("score"), "k.id", "k.distance", *[f"k.{c}" for c in rest])


def quota(ranked: DataFrame, limit: int = 1200, share: float = 0.75) -> DataFrame:
    """``limit`` names: the best of A for ``share`` of the places, the best of B for the rest, then whoever is next."""
    a = -int(-limit * share // 1)
    order = [F.desc("score"), F.asc("name")]
    own = Window.partitionBy("grade").orderBy(*order)
    first = ranked.withColumn("in_grade", F.row_number().over(own)).where(F.col("in_grade") <= limit)
    picked = first.withColumn("picked", F.when(F.col("grade") == "A", F.col("in_grade") <= a).otherwise(F.col("in_grade") <= limit - a))
    # At most 2 * limit rows are left here.
    line = Window.partitionBy(F.lit(0)).orderBy(F.desc("picked"), *order)
    return picked.withColumn("place", F.row_number().over(line)).where(F.col("place") <= limit).drop("in_grade")


def raw_pairs(units: DataFrame) -> DataFrame:
    """Every ordered pair of two different lexicon units (the output is that product), with summary scores."""
    a = units.select(F.col("unit").alias("u1"), F.col("category").alias("c1"), F.col("feminine").alias("f1"), F.col("usability").alias("s1"), F.col("family").alias("y1"))
    b = units.select(F.col("unit").alias("u2"), F.col("category").alias("c2"), F.col("feminine").alias("f2"), F.col("usability").alias("s2"), F.col("family").alias("y2"))
    return a.join(b, F.col("u1") != F.col("u2")).select(F.concat("u1", "u2").alias("name"), "u1", "u2", "c1", "c2", T.round_half_up((F.col("f1") + F.col("f2")) / 2, 1).alias("feminine"), T.round_half_up((F.col("s1") + F.col("s2")) / 2, 1).alias("usability"), (F.col("y1") + F.col("y2")).alias("family"))


def browse(pool: DataFrame, feminine: float, category: str | None = None, query: str | None = None, family: bool = False) -> DataFrame:
    """The browse filter over raw pairs: substring, category in either place, threshold, family only."""
    out = pool.where(F.col("feminine") >= feminine)
    if query:
        out = out.where(F.col("name").contains(query))
    if category:
        out = out.where((F.col("c1") == category) | (F.col("c2") == category))
    return out.where("family > 0") if family else out


def interleave(pool: DataFrame) -> DataFrame:
    """Round-robin over category pairs: ``name, turn, offset``; first one of each pair of categories, by diagonal, then the next."""
    categories = pool.select(F.col("c1").alias("c")).union(pool.select(F.col("c2").alias("c"))).distinct()
    numbered = categories.select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("k"))  # a few categories
    size = numbered.groupBy().agg(F.count("*").alias("size"))
    placed = place_within(pool.select("name", "c1", "c2"), ["c1", "c2"], [F.asc("name")]).withColumn("turn", F.col("place") - 1)
    at = placed.join(numbered.select(F.col("c").alias("c1"), F.col("k").alias("k1")), "c1").join(numbered.select(F.col("c").alias("c2"), F.col("k").alias("k2")), "c2")
    return at.join(F.broadcast(size)).select("name", "turn", ((F.col("k2") - F.col("k1") + F.col("size")) % F.col("size")).alias("offset"), "k1")


def allusions(fragments: DataFrame, units: DataFrame, reach: int = 12) -> DataFrame:
    """Pairs of lexicon units up to ``reach`` usable places apart in a fragment: ``id, name, grade``.

    Places count usable units only. Each pair of a fragment once; A if the two stand together anywhere in the quote.
    """
    exploded = fragments.select("id", "quote", F.posexplode(T.characters(F.col("quote"))).alias("at", "unit")).join(units.select("unit"), "unit", "left_semi")
    line = exploded.groupBy("id", "quote").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "unit"))), lambda x: x.unit).alias("usable"))
    first = line.select("id", "quote", "usable", F.posexplode("usable").alias("i", "u1")).select("id", "quote", "u1", F.explode(F.slice("usable", F.col("i") + 2, F.lit(reach))).alias("u2"))
    found = first.where("u1 <> u2").select("id", "quote", F.concat("u1", "u2").alias("name")).distinct()
    return found.select("id", "name", F.when(F.instr("quote", F.col("name")) > 0, "A").otherwise("B").alias("grade"))


def clauses(passages: DataFrame, raw: str, normal: str) -> DataFrame:
    """``id, n, clause, plain, start, closes``: clauses with searchable characters and their offset among these."""
    split = passages.select("id", F.posexplode(T.split_clauses(T.nfc(F.col("text")))).alias("k", "clause"))
    plain = split.withColumn("plain", T.han_only(T.simplified(F.col("clause"), raw, normal))).where("plain <> ''")
    order = Window.partitionBy("id").orderBy("k")
    before = F.coalesce(F.sum(F.char_length("plain")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return plain.select("id", F.row_number().over(order).alias("n"), "clause", "plain", before.cast("int").alias("start"), F.col("clause").rlike(f"[{T.SENTENCE_END}]$").alias("closes"))


def windows(passages: DataFrame, units: DataFrame, aliases: tuple[str, str]) -> DataFrame:
    """Scored windows: ``id, start, end, text, score, opportunities, naming``.

    Single clauses up to 40, slices of 24 every 16 of longer ones, and two clauses of one sentence. Of windows with the same span
    the best stays.
    """
    parts = clauses(passages, *aliases)
    order = Window.partitionBy("id").orderBy("n")
    parts = parts.withColumn("next_clause", F.lead("clause").over(order)).withColumn("next_plain", F.lead("plain").over(order))
    length = F.char_length("plain")
    single = parts.where(length <= 40).select("id", "start", (F.col("start") + length).alias("end"), F.col("clause").alias("text"), "plain", F.lit(0).alias("penalty"))
    cut = parts.where(length > 40).select("id", "start", "plain", F.explode(F.sequence(F.lit(0), length - 8, F.lit(16))).alias("o"), length.alias("len")).where("o = 0 or o + 8 < len")
    cut = cut.where("o - 16 + 24 < len").select("id", (F.col("start") + F.col("o")).alias("start"), (F.col("start") + F.least(F.col("o") + 24, "len")).alias("end"), F.substr("plain", F.col("o") + 1, F.lit(24)).alias("plain"))
    cut = cut.select("id", "start", "end", F.col("plain").alias("text"), "plain", F.lit(80).alias("penalty"))
    double = parts.where("not closes and next_plain is not null").select("id", "start", (F.col("start") + length + F.char_length("next_plain")).alias("end"), F.concat("clause", "next_clause").alias("text"), F.concat("plain", "next_plain").alias("plain"), F.lit(0).alias("penalty"))
    all_ = single.unionByName(cut).unionByName(double)
    size = F.char_length("plain")
    fit = all_.where(size.between(4, 40) & ~F.col("plain").rlike(f"[{WINDOW_NEGATIVE}]") & (F.regexp_count("text", F.lit(f"[{WARFARE}]")) <= 1) & ~F.col("text").rlike(r"[|\d()（）\[\]{}]"))
    chars = T.characters(F.col("plain"))
    fit = fit.withColumn("chars", chars).withColumn("repeats", F.size(F.filter(F.transform("chars", lambda c, i: c == F.get("chars", i - 1)), lambda x: x)))
    known = units.where(~F.col("unit").rlike(f"[{FUNCTION_CHARACTERS}]"))
    scored = lambda n: known.select(F.col("unit").alias(f"u{n}"), F.col("feminine").alias(f"f{n}"), F.col("usability").alias(f"s{n}"), F.col("rarity").alias(f"r{n}"))
    first = fit.select("id", "start", "end", "text", "penalty", "repeats", size.alias("size"), "chars", F.posexplode("chars").alias("i", "u1"))
    met = first.select("*", F.posexplode(F.slice("chars", F.col("i") + 2, F.lit(NEAR))).alias("gap", "u2")).drop("chars").where("u1 <> u2").join(scored(1), "u1").join(scored(2), "u2")
    continuity = F.when(F.col("gap") == 0, 160.0).otherwise(F.greatest(F.lit(30.0), 95.0 - (F.col("gap") + 1) * 18))
    met = met.withColumn("pair_score", (F.col("f1") + F.col("f2")) / 2 * 28 + (F.col("s1") + F.col("s2")) / 2 * 24 + (F.col("r1") + F.col("r2")) / 2 * 8 + continuity)
    grouped = met.groupBy("id", "start", "end", "text", "penalty", "size", "repeats").agg(F.sort_array(F.collect_list("pair_score"), False).alias("s"), F.count("*").alias("opportunities"), F.array_sort(F.array_union(F.collect_set("u1"), F.collect_set("u2"))).alias("naming"))
    score = F.get("s", 0) + F.coalesce(F.get("s", 1), F.lit(0.0)) * 0.3 + F.least("opportunities", F.lit(12)) * 4 - F.col("size") * 0.5 - F.col("repeats") * 40 - F.col("penalty")
    kept = grouped.select("id", "start", "end", "text", score.alias("score"), "opportunities", "naming")
    best = kept.groupBy("id", "start", "end").agg(F.max(F.struct("score", "text", "opportunities", "naming")).alias("w"))
    return best.select("id", "start", "end", "w.text", "w.score", "w.opportunities", "w.naming")


def nameability(passages: DataFrame, found: DataFrame, books: DataFrame) -> DataFrame:
    """``id, score, naming`` of every passage: its best window, a part of the second and its book's priority; -100000 without a window."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "start", "end"))
    top = found.withColumn("w", place).where("w <= 3").groupBy("id").agg(F.max(F.when(F.col("w") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("w") == 2, F.col("score"))).alias("s2"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("naming")))).alias("naming"))
    shelf = books.select(F.col("id").alias("book_id"), F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("priority", F.lit(2)))).alias("p"))
    rows = passages.select("id", "book_id").join(shelf, "book_id", "left").join(top, "id", "left")
    score = F.coalesce(F.col("s1") + F.coalesce("s2", F.lit(0.0)) * 0.35 + (4 - F.coalesce("p", F.lit(2))) * 30, F.lit(-100000.0))
    return rows.select("id", score.alias("score"), F.coalesce("naming", F.array().cast("array<string>")).alias("naming"))


def usable_source(text: Column, normalized: Column, score: Column) -> Column:
    """Whether a passage may feed the mining: length, negative and noisy content, score."""
    size = F.char_length(normalized)
    return size.between(8, 480) & ~text.rlike(f"[{HARD_NEGATIVE}]") & (F.regexp_count(text, F.lit(f"[{WARFARE}]")) <= 2) & (F.regexp_count(text, F.lit(r"[|\d]")) <= F.greatest(F.lit(3.0), size * 0.04)) & (score > -15)


def selection_pool(passages: DataFrame, per_book: int) -> DataFrame:
    """The candidates of a diverse selection: the best of all, and a few of every book; each flagged by what brought it in.

    Also the selection's parameters: ``target, book_limit, work_limit``.
    """
    sizes = passages.agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("books"), F.countDistinct("book_id", "work_title").alias("works")).first()
    target = min(sizes.n, per_book * sizes.books)
    up = lambda a, b: -(-a // b) if b else 0
    pool = min(sizes.n, max(256, target * 6))
    fallback = max(1, up(target, sizes.books))
    limits = {"target": target, "book_limit": max(3, up(target * 8, 100), up(target, sizes.books)), "work_limit": max(2, up(target * 4, 100), up(target, sizes.works))}
    order = [F.desc_nulls_last("score"), F.asc("id")]
    best = passages.orderBy(*order).limit(pool).select("id").withColumn("is_best", F.lit(True))
    own = passages.select("id", "book_id", "score").withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy(*order))).where(F.col("k") <= fallback).select("id").withColumn("is_fallback", F.lit(True))
    chosen = best.join(own, "id", "full")
    return passages.join(chosen, "id").select("id", "book_id", "work_title", "score", F.coalesce("is_best", F.lit(False)).alias("is_best"), F.coalesce("is_fallback", F.lit(False)).alias("is_fallback"), *[F.lit(v).alias(k) for k, v in limits.items()])


def batches(selected: DataFrame, size: int) -> DataFrame:
    """``batch, batch_id, ids``: consecutive groups of a selection, in its order; the id has a digest of the members."""
    at = selected.select(F.floor((F.col("place") - 1) / size).cast("int").alias("batch"), "place", "id")
    grouped = at.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x.id).alias("ids"))
    digest = F.substring(F.sha2(F.array_join("ids", "\n"), 256), 1, 12)
    return grouped.select("batch", F.format_string("source-%04d-%s", F.col("batch") + 1, digest).alias("batch_id"), "ids")
