"""Queries over candidates, their sources and reviews, and over profiles; registered with the catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.functions import jsontext
from inkstrata.functions import text as T
from inkstrata.operators import candidates as C
from inkstrata.operators import mining, pool, preference
from inkstrata.sources import sinks

from .catalog import Tables, _choice, discovery_pool, query


def _mined(spark, sf_dir) -> DataFrame:
    return discovery_pool(spark, sf_dir).select("name", "id", "grade", "feminine", "rarity", "usability")


def _curated(t: Tables) -> DataFrame:
    return t.name_candidates.select(F.col("given_name").alias("name"), "id", "grade", "feminine", "rarity", "usability")


def _united(spark, sf_dir) -> DataFrame:
    return C.united(_mined(spark, sf_dir), _curated(Tables(spark, sf_dir)).where("grade = 'A'"))


def _answers(t: Tables) -> DataFrame:
    """Every answer once: profile, left, right (items), choice, at, seq."""
    names = t.name_candidates.select(F.explode(F.array_distinct(F.array("given_name", "full_name"))).alias("name"), F.col("given_name").alias("item"))
    rows = t.pairwise_feedback.groupBy("feedback_id").agg(F.min(F.struct("received_at", "profile_id", "left_name", "right_name", "choice", "recorded_at")).alias("f")).select("feedback_id", "f.*")
    sides = rows.join(names.select(F.col("name").alias("left_name"), F.col("item").alias("left")), "left_name").join(names.select(F.col("name").alias("right_name"), F.col("item").alias("right")), "right_name")
    return sides.where("profile_id is not null and left <> right").select(F.col("profile_id").alias("profile"), "left", "right", _choice().alias("choice"), F.col("recorded_at").alias("at"), F.col("feedback_id").alias("seq"))


def _lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names that any profile preferred at least half of the times it had the choice, and those in a both-dislike."""
    answers = _answers(t)
    sided = answers.where("choice in ('left', 'right')").select(F.explode(F.array(F.struct(F.col("left").alias("name"), (F.col("choice") == "left").alias("won")), F.struct(F.col("right").alias("name"), (F.col("choice") == "right").alias("won")))).alias("s")).select("s.*")
    liked = sided.groupBy("name").agg(F.count_if("won").alias("w"), F.count("*").alias("n")).where("2 * w >= n").select("name")
    return liked, preference.disliked(answers).where("profile = 'prf-00-00000'").select(F.col("item").alias("name")).distinct()


@query
def discovery_union(spark, sf_dir):
    return _united(spark, sf_dir)


@query
def discovery_views(spark, sf_dir):
    """What each mode shows, one row for each mode and name."""
    shown, (liked, dropped) = _united(spark, sf_dir), _lists(Tables(spark, sf_dir))
    parts = [C.view(shown, mode, liked, dropped).select(F.lit(mode).alias("mode"), "name") for mode in C.MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def curated_views(spark, sf_dir):
    t = Tables(spark, sf_dir)
    liked, dropped = _lists(t)
    rows = t.name_candidates.select(F.col("given_name").alias("name"), F.concat_ws("·", "book_title", "work_title").alias("source"), "quote", (F.col("grade") == "A").alias("passed"))
    parts = [C.curated_view(rows, shown, liked, dropped, "。").select(F.lit(shown).alias("view"), "name") for shown in ("passed", "favourites", "excluded")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def allusion_browse(spark, sf_dir):
    t = Tables(spark, sf_dir)
    quotes = t.name_candidates.select("id", T.simplified(F.col("quote"), *t.aliases).alias("quote"))
    known = quotes.join(t.name_candidates.select("id", F.concat_ws("·", "book_title", "work_title").alias("source"), F.col("category").alias("corpus")), "id")
    return C.browse_allusions(mining.allusions(quotes, t.lexicon).join(known, "id"), "，", "B", "子").select("id", "name", "source")


@query
def auto_style(spark, sf_dir):
    return Tables(spark, sf_dir).name_candidates.select("id", C.style_of(F.col("feminine"), F.col("rarity"), F.col("usability")).alias("style"), C.relation_of(F.col("grade")).alias("relation"))


@query
def risk_kinds(spark, sf_dir):
    return Tables(spark, sf_dir).passages.select("id", C.risk_kind(F.col("text")).alias("kind"))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode("features").alias("k", "value")).withColumn("value", T.round_half_up(F.col("value"), 9))


@query
def features_seed(spark, sf_dir):
    style = C.style_of(F.col("feminine"), F.col("rarity"), F.col("usability"))
    return _exploded(Tables(spark, sf_dir).name_candidates.select("id", C.seed_features(style, F.col("grade"), F.col("quote"), F.col("chapter_title")).alias("features")))


@query
def features_reviewed(spark, sf_dir):
    style = C.style_of(F.col("feminine"), F.col("rarity"), F.col("usability"))
    scores = dict(femininity=F.col("feminine") / 5, feel=F.col("usability") / 5, distinctiveness=F.col("rarity") / 5, phonology=F.col("feminine") / 6, usability=F.col("usability") / 5)
    return _exploded(Tables(spark, sf_dir).name_candidates.select("id", C.reviewed_features(style, C.relation_of(F.col("grade")), scores, F.when(F.col("family_score") >= 2.5, "有")).alias("features")))


@query
def adjusted_fit(spark, sf_dir):
    """The fit with a bounded share of a second score, in the order in which it is shown."""
    from inkstrata.operators.numbering import place_within

    rows = Tables(spark, sf_dir).name_candidates.select("id", C.adjusted(F.coalesce(F.col("feminine"), F.lit(0.0)) / 4, F.col("category") == "字书", F.col("grade") == "A", F.coalesce(F.col("rarity"), F.lit(0.0)) / 40, F.col("usability") * 22).alias("a")).select("id", "a.*")
    placed = place_within(rows.withColumn("_shown", F.coalesce("adjusted", F.lit(-1.0))), [], [F.desc("_shown"), F.asc("id")])
    return placed.select("id", "weight", "adjusted", "status", "place")


@query
def rerank(spark, sf_dir):
    base = pool.weighted_score({"feminine": 5.0, "family_score": 3.0, "rarity": 3.0, "usability": 2.0}, F.col("grade") == "A")
    rows = Tables(spark, sf_dir).name_candidates.select("id", C.reranked(base, F.col("usability") * 20, F.lit(0.1)).alias("score"))
    return pool.competition_rank(rows, "score").select("id", "score", "rank")


@query
def family_proxy(spark, sf_dir):
    tag = lambda u: F.element_at(F.array(F.lit("玉"), F.lit("影"), F.lit("绍"), F.lit("")), (F.ascii(u) % 4 + 1).cast("int"))
    rows = mining.raw_pairs(Tables(spark, sf_dir).lexicon)
    return rows.select("name", C.family_worth([tag("u1"), tag("u2")], [F.col("u1"), F.col("u2")]).alias("worth"))


def _pointers(t: Tables) -> DataFrame:
    """Two pointers of each candidate: its characters' first places in its own passage, and for every other one the second in the next one's."""
    from inkstrata.operators.numbering import place_within

    numbered = place_within(t.name_candidates.select("id", "given_name", "grade", "passage_id"), [], [F.asc("id")], "n")
    nxt = numbered.select((F.col("n") - 1).alias("n"), F.col("passage_id").alias("next"))
    rows = numbered.join(nxt, "n", "left").withColumn("p2", F.when(F.col("n") % 3 == 0, F.coalesce("next", "passage_id")).otherwise(F.col("passage_id")))
    plain = lambda p: t.passages.select(F.col("id").alias(p), F.col("normalized_text").alias(f"t_{p}"))
    both = rows.withColumnRenamed("passage_id", "p1").join(plain("p1"), "p1").join(plain("p2"), "p2")
    place = lambda p, k: F.coalesce(F.instr(f"t_{p}", F.substring("given_name", k, 1)), F.lit(0)) - 1
    return both.select("id", F.col("given_name").alias("name"), "grade", "p1", place("p1", 1).alias("i1"), "p2", place("p2", 2).alias("i2"))


@query
def pointer_relations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = C.pointer_relations(_pointers(t).where("i1 >= 0").select("id", "p1", "i1", "p2", F.greatest("i2", F.lit(0)).alias("i2")), t.passages, t.aliases)
    return found.withColumn("proposal", C.proposal_id(F.lit("source-0001"), F.col("p1"), F.col("i1"), F.col("p2"), F.col("i2")))


@query
def proposal_issues(spark, sf_dir):
    t = Tables(spark, sf_dir)
    name = lambda k: T.simplified(F.substring("name", k, 1), *t.aliases)
    wanted = _pointers(t).select("id", "name", C.relation_of(F.col("grade")).alias("relation"), "p1", name(1).alias("c1"), F.lit(0).alias("o1"), F.when(F.col("i2") < 0, "gone").otherwise(F.col("p2")).alias("p2"), name(2).alias("c2"), F.lit(1).alias("o2"))
    return C.proposal_issues(wanted, t.passages, t.aliases)


def _reviewed(t: Tables) -> DataFrame:
    decision = F.element_at(F.create_map(*[F.lit(x) for x in ("left", "approve", "right", "reject", "both-dislike", "manual-review")]), F.col("choice"))
    reviews = _answers(t).where("profile < 'prf-00-00003'").select(F.col("left").alias("id"), F.struct("at", "seq").alias("seq"), F.coalesce(decision, F.lit("reject")).alias("decision"))
    return C.reviewed(t.name_candidates.select(F.col("given_name").alias("id")), reviews)


@query
def review_join(spark, sf_dir):
    return _reviewed(Tables(spark, sf_dir))


@query
def review_counts(spark, sf_dir):
    rows = _reviewed(Tables(spark, sf_dir))
    return rows.agg(F.count("*").alias("all"), *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("approved", "manual-review", "rejected")])


@query
def in_several(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = mining.raw_pairs(t.lexicon).select("name")
    return C.in_several({"mined": discovery_pool(spark, sf_dir).select("name"), "curated": t.name_candidates.select(F.col("given_name").alias("name")), "raw": raw})


@query
def merge_by_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    curated = t.name_candidates.select(F.col("given_name").alias("name"), "id", F.col("feminine").alias("score"), F.col("passage_id").alias("citation"))
    mined = discovery_pool(spark, sf_dir).select("name", F.col("id"), F.col("feminine").alias("score"), F.col("id").alias("citation"))
    merged = C.merged_by_score(mined.unionByName(curated.where("score is not null")))
    return merged.withColumn("citations", F.array_join("citations", ","))


@query
def calibration_batches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ranks = {r.id: k for k, r in enumerate(t.corpus_books.where("status = 'ready'").orderBy("priority", "id").select("id").limit(11).collect())}
    once = t.factory.where("book_id is not null").groupBy("id").agg(F.max(F.struct("score", "book_id")).alias("r")).select("id", "r.*")
    return C.calibration_first(once, ranks, 8)


@query
def core_catalogue(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sources = t.corpus_books.where("source is not null").select("id", F.col("source.originUrl").alias("origin"))
    return C.with_source(t.corpus_books.where("status <> 'planned'").select("id", "title", "category"), sources)


@query
def dashboard(spark, sf_dir):
    """Counts of what there is, and of the candidates by grade and category."""
    t = Tables(spark, sf_dir)
    total = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit("total").alias("measure"), F.lit(name).alias("key"), "value")
    by = lambda c: t.name_candidates.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value")).select(F.lit(c).alias("measure"), "key", "value")
    curated = t.name_candidates
    return total(t.lexicon, "units").unionByName(total(mining.raw_pairs(t.lexicon), "pairs")).unionByName(total(curated, "curated")).unionByName(total(curated.where("grade = 'A'"), "passed")).unionByName(by("grade")).unionByName(by("category"))


@query
def profile_shortlist(spark, sf_dir):
    """Per profile at most ten distinct names: those it couldn't decide on, those it chose, then the six best of all."""
    t = Tables(spark, sf_dir)
    answers = _answers(t)
    order = F.struct("at", "seq", "side")
    sided = answers.select("profile", "choice", "at", "seq", F.posexplode(F.array("left", "right")).alias("side", "item"))
    listed = lambda rule: sided.where(rule).groupBy("profile", "item").agg(F.min(order).alias("k")).select("profile", "item", F.struct(F.col("k.at").alias("at"), (F.col("k.seq") * 2 + F.col("k.side")).alias("n")).alias("ord"))
    best = t.name_candidates.where("feminine is not null").orderBy(F.desc("feminine"), F.asc("id")).limit(6).select("given_name").collect()  # six names
    top = answers.select("profile").distinct().select("profile", F.posexplode(F.array(*[F.lit(r[0]) for r in best])).alias("n", "item"))
    lists = [listed("choice = 'skip'"), listed("choice = 'left' and side = 0 or choice = 'right' and side = 1"), top.select("profile", "item", F.struct(F.lit(None).cast("timestamp").alias("at"), F.col("n").cast("bigint").alias("n")).alias("ord"))]
    return C.shortlist(lists, ["profile"], "item")


@query
def pairwise_dislikes(spark, sf_dir):
    return preference.disliked(_answers(Tables(spark, sf_dir)))


def _undoing(t: Tables) -> DataFrame:
    """The reactions with a view as the undo of an earlier one; few items, so that undos meet reactions."""
    rows = t.events.where("event_type <> 'click' and user_id is not null")
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "love", "signup", "like", "error", "dislike", "view", "undo")])
    return rows.select(F.col("user_id").alias("user"), (F.col("event_id") % 20).cast("string").alias("item"), F.element_at(kind, F.col("event_type")).alias("reaction"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query
def undo_fold(spark, sf_dir):
    t = Tables(spark, sf_dir)
    users = preference.reaction_weights(_undoing(t), t.item_features, 13)
    return users.select("user", F.posexplode("weights").alias("k", "weight"), "events").withColumn("weight", T.round_half_up(F.col("weight"), 6))


@query
def undo_order(spark, sf_dir):
    return preference.reacted_in_order(_undoing(Tables(spark, sf_dir))).select("user", "item", "seq")


@query
def undo_exposure(spark, sf_dir):
    t = Tables(spark, sf_dir)
    shown = t.events.where("event_type = 'click' and user_id is not null").select(F.col("user_id").alias("user"), (F.col("event_id") % 20).cast("string").alias("item"))
    return preference.exposure_counts(shown, _undoing(t))


@query
def list_states(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "favourite", "signup", "favourite", "error", "reject", "view", "compare", "click", "compare")])
    events = Tables(spark, sf_dir).events.where("user_id is not null").select(F.col("user_id").alias("user"), (F.col("event_id") % 9).cast("string").alias("item"), F.element_at(kind, F.col("event_type")).alias("list"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    states = preference.list_states(events)
    return states.select("user", *[F.array_join(c, ",").alias(c) for c in ("favourites", "rejected", "compared", "explicit")])


@query
def sound_keys(spark, sf_dir):
    """The sounds of names without blanks and hyphens, here over the titles of documents."""
    return Tables(spark, sf_dir).documents.where("title is not null").select("doc_id", T.pinyin_key(F.col("title")).alias("key"))


@query
def json_recovery(spark, sf_dir):
    """The first JSON value of a text that has something behind it."""
    broken = F.concat(F.lit("  "), "props", F.lit(" and "), F.col("event_type"), F.lit(" {}"))
    return Tables(spark, sf_dir).events.select("event_id", jsontext.first_value(broken).alias("value"))


@query
def size_gate(spark, sf_dir):
    """Passages whose stored text is above a kilobyte, as artifacts of their own."""
    return sinks.too_large(Tables(spark, sf_dir).passages.select(F.col("id").alias("name"), F.col("text").alias("content")), {}, 1024)
