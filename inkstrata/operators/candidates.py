"""Candidates between mining and choice: unions with precedence, views, features, relations of their sources, reviews, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T

from .numbering import place_within
from .pool import unit_interval

#: What tells a risk's kind (the first that matches), and what makes a seed's sound, writing or rarity doubtful.
RISK_KINDS = {"source-context": "墓|葬|原典|語境|语境|諷|讽|貶|贬", "pronunciation": "音|讀|读|聲|声", "name-collision": "人物|角色|同名|碰撞", "usability": "錄入|录入|識讀|识读|字形"}
SOUND_RISK, WRITING_RISK, COMMON_RISK = "讀|读|音|聲|声|多音|上聲|上声|去聲|去声|陽平|阳平", "識讀|识读|字形|繁|成本|難寫|难写", "熟悉|常見|常见|使用較多|使用较多|重名|熟語|熟语|過於熟|过于熟"
#: What a proposal's source must not hold.
PROPOSAL_NEGATIVE = "墓葬死丧喪刑杀殺哀殇殤讽諷贬貶讥譏恨泪淚病疫苦怨鬼尸血灾災祸禍败敗辱贱賤恶惡凶"
#: What family tags and characters are worth.
FAMILY_TAGS, FAMILY_UNITS = {"玉": 2.5, "影": 2.0, "绍": 1.5}, {"玉": 1.0, "影": 1.0, "韶": 1.5}
MODES = ("a-only", "curated", "favorites", "evidence")
RELATIONS = ("exact-phrase", "clause-related", "passage-related", "cultural-recomposition")


def united(mined: DataFrame, curated: DataFrame, key: str = "name") -> DataFrame:
    """Both with ``origin``; a curated row takes the place of a mined one of its name. Of several of one origin the greatest id stays.

    Both have ``name, id`` and the same further columns. Rows are reduced before they are moved.
    """
    rows = mined.withColumn("origin", F.lit("corpus")).unionByName(curated.withColumn("origin", F.lit("curated")))
    rest = [c for c in rows.columns if c not in (key, "origin", "id")]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col("origin") == "curated", "id", "origin", *rest)).alias("k"))
    return best.select(key, "k.origin", "k.id", *[f"k.{c}" for c in rest])


def graceful(feminine: Column, usability: Column, name: Column) -> Column:
    """Whether scores and characters make a name worth showing."""
    return (feminine >= 4) & (usability >= 3.5) & (F.substring(name, 1, 1) != F.substring(name, 2, 1))


def view(candidates: DataFrame, mode: str, favourites: DataFrame, rejected: DataFrame) -> DataFrame:
    """The candidates a mode shows: name, origin, grade, feminine, usability and the like. Rejected names (``name``) show among favourites only."""
    worth = graceful(F.col("feminine"), F.col("usability"), F.col("name"))
    if mode == "favorites":
        return candidates.join(favourites.select("name").distinct(), "name", "left_semi")
    rule = {"a-only": (F.col("grade") == "A") & worth, "curated": F.col("origin") == "curated", "evidence": F.col("grade").isin("A", "B") & worth}[mode]
    return candidates.where(rule).join(rejected.select("name"), "name", "left_anti")


def curated_view(candidates: DataFrame, shown: str, favourites: DataFrame, rejected: DataFrame, query: str = "") -> DataFrame:
    """Curated candidates (name, source, quote, passed) that hold the query: ``passed`` ones, ``favourites``, or ``excluded`` ones."""
    rows = candidates
    if query.strip():
        rows = rows.where(F.coalesce(F.col("name").contains(query.strip()) | F.col("source").contains(query.strip()) | F.col("quote").contains(query.strip()), F.lit(False)))
    mine, dropped = (df.select("name").distinct() for df in (favourites, rejected))
    if shown == "favourites":
        return rows.join(mine, "name", "left_semi")
    if shown == "passed":
        return rows.where("passed").join(dropped, "name", "left_anti")
    flagged = rows.join(dropped.withColumn("_was", F.lit(True)), "name", "left")
    return flagged.where("not passed or _was").drop("_was")


def browse_allusions(pairs: DataFrame, query: str = "", grade: str | None = None, corpus: str | None = None) -> DataFrame:
    """Allusion pairs (name, quote, source, grade, corpus) whose name, quote or source holds the query, of a grade and a corpus."""
    out, wanted = pairs, query.strip()
    if wanted:
        out = out.where(F.coalesce(F.col("name").contains(wanted), F.lit(False)) | F.coalesce(F.col("quote").contains(wanted), F.lit(False)) | F.coalesce(F.col("source").contains(wanted), F.lit(False)))
    if grade is not None:
        out = out.where(F.col("grade") == grade)
    return out if corpus is None else out.where(F.col("corpus") == corpus)


def style_of(feminine: Column, rarity: Column, usability: Column) -> Column:
    return F.when(rarity >= 4.1, "austere").when(feminine >= 4.2, "graceful").when(usability >= 4.1, "bright").otherwise("classical")


def relation_of(grade: Column) -> Column:
    return F.when(grade == "A", RELATIONS[0]).when(grade == "B", RELATIONS[1]).when(grade == "C", RELATIONS[2]).otherwise(RELATIONS[3])


def risk_kind(text: Column) -> Column:
    """The kind of the first pattern that a risk's text matches; risks of no known kind count as source-context."""
    kind = F
    for name, pattern in RISK_KINDS.items():
        kind = kind.when(text.rlike(pattern), name)
    return kind.otherwise("source-context")


def seed_features(style: Column, grade: Column, risk: Column, family_note: Column) -> Column:
    """13 features of a reviewed seed: by its style, and lowered by what its risk says."""
    own = lambda name, yes, no: F.when(style == name, yes).otherwise(no)
    doubt = lambda pattern, yes, no: F.when(F.coalesce(risk, F.lit("")).rlike(pattern), yes).otherwise(no)
    values = [own("modern", 0.55, 0.9), own("graceful", 0.95, 0.45), own("gentle", 0.95, 0.4), own("bright", 0.95, 0.35), own("austere", 0.95, 0.35), own("modern", 0.9, 0.25), doubt(SOUND_RISK, 0.55, 0.9), doubt(WRITING_RISK, 0.55, 0.9), doubt(WRITING_RISK, 0.55, 0.9), doubt(COMMON_RISK, 0.3, 0.7)]
    values += [F.when(F.coalesce(family_note, F.lit("")).rlike("無直接|无直接"), 0.1).otherwise(0.65), F.when(grade == "A", 1.0).otherwise(0.25), F.when(grade.isin("C", "D"), 1.0).otherwise(0.2)]
    return F.array(*[unit_interval(v) for v in values])


def reviewed_features(style: Column, relation: Column, scores: dict[str, Column], family: Column) -> Column:
    """13 features of a reviewed candidate. ``scores``: femininity, feel, distinctiveness, phonology, usability in [0, 1]; ``family``: its note."""
    own = lambda name, yes, no: F.when(style == name, F.lit(yes)).otherwise(no)
    by = lambda first, second, third: F.when(relation == first[0], first[1]).when(relation == second[0], second[1]).otherwise(third)
    f, n, d = scores["femininity"], scores["feel"], scores["distinctiveness"]
    values = [own("modern", 0.58, F.lit(0.92)), own("graceful", 0.96, f * 0.68), own("gentle", 0.95, f * 0.55), own("bright", 0.95, n * 0.3 + 0.35), own("austere", 0.95, d * 0.35 + 0.3), own("modern", 0.9, F.lit(0.18))]
    values += [scores["phonology"], scores["usability"], scores["usability"], d, F.when(F.trim(F.coalesce(family, F.lit(""))) != "", 0.85).otherwise(0.08)]
    values += [by((RELATIONS[0], 1.0), (RELATIONS[1], 0.68), 0.28), by((RELATIONS[3], 1.0), (RELATIONS[2], 0.72), 0.15)]
    return F.array(*[unit_interval(v) for v in values])


def adjusted(fit: Column, blocked: Column, born: Column, weight: Column, score: Column) -> Column:
    """A struct of the weight in effect, the adjusted fit (null if blocked) and a status: a bounded share of a second score goes into the fit."""
    own, share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fit)), F.least(F.lit(0.1), F.greatest(F.lit(0.0), weight))
    mixed = T.round_half_up(own * (1 - share) + F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)) / 100 * share, 3)
    what = lambda w, v, s: F.struct(w.alias("weight"), v.cast("double").alias("adjusted"), F.lit(s).alias("status"))
    return F.when(blocked, what(F.lit(0.0), F.lit(None), "blocked")).when(~born, what(F.lit(0.0), own, "not yet born")).when(score.isNull(), what(share, own, "no score")).otherwise(what(share, mixed, "recorded"))


def reranked(base: Column, score: Column, weight: Column) -> Column:
    """The base score with a share of a second score in it (a missing one counts 0), to one digit; 0 stays 0."""
    return F.when(base == 0, 0.0).otherwise(T.round_half_up(base * (1 - weight) + F.coalesce(score, F.lit(0.0)) * weight, 1))


def family_worth(tags: list[Column], units: list[Column]) -> Column:
    """What the tags and characters of a name's members are worth to the family, at most 5."""
    total = F.lit(0.0)
    for columns, worth in ((tags, FAMILY_TAGS), (units, FAMILY_UNITS)):
        for column in columns:
            for value, points in worth.items():
                total = total + F.when(column == value, points).otherwise(0.0)
    return F.least(F.lit(5.0), T.round_half_up(total, 1))


def sentence_number(text: Column, index: Column, aliases: tuple[str, str]) -> Column:
    """The number of the sentence that holds a searchable character's place; places behind all sentences have -1. The text must be composed."""
    sizes = F.transform(T.split_sentences(text), lambda s: F.char_length(T.han_only(T.simplified(s, *aliases))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    passed = F.aggregate(sizes, start, lambda s, size: F.struct((s.end + size).alias("end"), (s.n + (s.end + size <= index).cast("int")).alias("n")))
    return F.when(index < passed.end, passed.n).otherwise(-1)


def pointer_relations(pairs: DataFrame, passages: DataFrame, aliases: tuple[str, str]) -> DataFrame:
    """``pairs`` (id, p1, i1, p2, i2: a passage and a place in its searchable text, twice) with ``relation``; without one if a passage is missing."""
    plain = passages.select("id", "book_id", "work_title", T.nfc(F.col("text")).alias("text"))
    side = lambda n: plain.select(*[F.col(c).alias(f"{c}{n}") for c in plain.columns])
    rows = pairs.join(side(1).withColumnRenamed("id1", "p1"), "p1").join(side(2).withColumnRenamed("id2", "p2"), "p2")
    one = F.col("p1") == F.col("p2")
    sentence = lambda n: sentence_number(F.col(f"text{n}"), F.col(f"i{n}"), aliases)
    work = (F.col("book_id1") == F.col("book_id2")) & (F.coalesce("work_title1", F.lit("")) != "") & (F.col("work_title1") == F.col("work_title2"))
    kind = F.when(one & (F.col("i2") == F.col("i1") + 1), RELATIONS[0]).when(one & (sentence(1) == sentence(2)), RELATIONS[1]).when(one | F.coalesce(work, F.lit(False)), RELATIONS[2]).otherwise(RELATIONS[3])
    return rows.select(*pairs.columns, kind.alias("relation"))


def proposal_id(batch: Column, *parts: Column) -> Column:
    """A batch's id and a digest of its own and a proposal's pointers."""
    return F.concat(batch, F.lit(":pointer-"), F.substring(F.sha2(F.concat_ws("\n", batch, *[p.cast("string") for p in parts]), 256), 1, 16))


def proposal_issues(proposals: DataFrame, passages: DataFrame, aliases: tuple[str, str]) -> DataFrame:
    """``id, code``: what speaks against a proposal (id, name, relation, p1, c1, o1, p2, c2, o2: passage, character and occurrence from 0).

    A missing passage, a character that doesn't occur that often, a passage with bad context, and a relation that its passages don't bear out.
    """
    known = passages.select("id", "book_id", "work_title", "normalized_text", T.search_text(F.col("text"), *aliases).alias("plain"))
    side = lambda n: known.select(F.col("id").alias(f"p{n}"), F.lit(True).alias(f"known{n}"), *[F.col(c).alias(f"{c}{n}") for c in known.columns[1:]])
    rows = proposals.join(side(1), "p1", "left").join(side(2), "p2", "left")
    rules = []
    for n in (1, 2):
        there = F.col(f"known{n}").isNotNull()
        count = F.size(F.filter(T.characters(F.col(f"plain{n}")), lambda c: c == F.col(f"c{n}")))  # noqa: B023
        rules += [(f"missing-source-{n}", ~there), (f"missing-character-{n}", there & (count <= F.col(f"o{n}"))), (f"negative-context-{n}", there & F.col(f"plain{n}").rlike(f"[{PROPOSAL_NEGATIVE}]"))]
    both, apart = F.col("known1").isNotNull() & F.col("known2").isNotNull(), F.col("p1") != F.col("p2")
    relation = F.col("relation")
    rules += [("false-exact-phrase", both & (relation == RELATIONS[0]) & (apart | ~F.coalesce(F.col("normalized_text1").contains(F.col("name")), F.lit(False))))]
    rules += [("false-clause-relation", both & (relation == RELATIONS[1]) & apart), ("false-passage-relation", both & (relation == RELATIONS[2]) & ~(F.col("book_id1").eqNullSafe(F.col("book_id2")) & F.col("work_title1").eqNullSafe(F.col("work_title2"))))]
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules]))).alias("code"))


def reviewed(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """``items`` (id, …) with ``status`` and ``reason`` from ``reviews`` (id, seq, decision); the last review of an id counts, a missing one rejects."""
    last = reviews.groupBy("id").agg(F.max(F.struct("seq", "decision")).alias("r")).select("id", "r.decision", F.lit(True).alias("_seen"))
    rows = items.join(last, "id", "left")
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "manual-review", "manual-review").otherwise("rejected")
    reason = F.when(F.col("_seen").isNull(), "no review").when(status == "rejected", "not approved")
    return rows.select(*items.columns, status.alias("status"), reason.alias("reason"))


def in_several(artifacts: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """``name, artifacts`` of names that stand in more than one artifact: empty means that the gate is open."""
    rows = None
    for label, df in artifacts.items():
        own = df.select(key).distinct().withColumn("artifact", F.lit(label))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("artifact")).alias("artifacts")).where("size(artifacts) > 1").select(key, F.array_join("artifacts", ",").alias("artifacts"))


def merged_by_score(rows: DataFrame, key: str = "name") -> DataFrame:
    """One row for each name: that with the greatest score (of equal ones the smallest id), with the citations of all. ``rows``: name, id, score, citation."""
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("k"), F.array_sort(F.collect_set("citation")).alias("citations"))
    return best.select(key, "k.id", (-F.col("k.s")).alias("score"), "citations")


def calibration_first(rows: DataFrame, ranks: dict[str, int], size: int, batches: int = 3) -> DataFrame:
    """``id, batch, calibrating``: a few batches of the first books' best rows, then all others in the order of ids. ``rows``: id, book_id, score."""
    rank = F.lit(1 << 30)
    for book, place in ranks.items():
        rank = F.when(F.col("book_id") == book, place).otherwise(rank)
    line = [F.asc("rank"), F.desc_nulls_last("score"), F.asc("id")]
    first = rows.withColumn("rank", rank).orderBy(*line).limit(size * batches)
    lead = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*line)))  # as many rows as the limit
    rest = place_within(rows.join(first.select("id"), "id", "left_anti").select("id"), [], [F.asc("id")])
    number = lambda df, flag, start: df.select("id", (F.floor((F.col("place") - 1) / size) + start).cast("int").alias("batch"), F.lit(flag).alias("calibrating"))
    return number(lead, True, 0).unionByName(number(rest, False, batches))


def with_source(books: DataFrame, sources: DataFrame) -> DataFrame:
    """Books with the source of the same id (id, origin); a book without one raises."""
    rows = books.join(sources.withColumn("_known", F.lit(True)), "id", "left")
    return rows.withColumn("origin", F.when(F.col("_known").isNotNull(), F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("no source: "), "id")))).drop("_known")


def shortlist(lists: list[DataFrame], keys: list[str], item: str, most: int = 10) -> DataFrame:
    """The first ``most`` distinct items of lists one behind the other (keys, item, ord): ``keys, item, place``."""
    rows = None
    for n, df in enumerate(lists):
        own = df.select(*keys, item, F.lit(n).alias("list"), "ord")
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy(*keys, item).agg(F.min(F.struct("list", "ord")).alias("k"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("k", item))).where(F.col("place") <= most)
    return placed.select(*keys, item, "place")
