"""The engine's queries on the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.functions import jsontext
from inkstrata.functions import text as T
from inkstrata.operators import index, mining, pool, preference, profiles, quality, search, selection
from inkstrata.operators.numbering import place_within
from inkstrata.session import checkpointed, shuffle_width, table
from inkstrata.sources import importers, sinks
from inkstrata.streaming import reactions as stream

from . import oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SURNAME = "岑"


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()


class Tables:
    """The tables of a folder as the operators see them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.at, name)

    @property
    def passages(self) -> DataFrame:
        return index.distinct_passages(table(self.spark, self.at, "corpus_passages"))

    @cached_property
    def settled(self) -> DataFrame:
        """The passages written once, for queries that read them again and again."""
        return checkpointed(self.passages)

    @cached_property
    def aliases(self) -> tuple[str, str]:
        return T.alias_strings(table(self.spark, self.at, "char_aliases"))

    @property
    def lexicon(self) -> DataFrame:
        return mining.lexicon(table(self.spark, self.at, "name_candidates"))

    @property
    def name_queries(self) -> DataFrame:
        names = table(self.spark, self.at, "name_candidates").select(T.given_query(F.col("full_name"), SURNAME).alias("query"))
        raw, normal = self.aliases
        plain = T.simplified(F.col("query"), raw, normal)
        return names.where("query <> ''").select("query", F.substring(plain, 1, 1).alias("u1"), F.when(F.char_length(plain) > 1, F.substring(plain, 2, 1)).alias("u2")).distinct()

    @property
    def factory(self) -> DataFrame:
        score = F.when(~F.isnan("score"), F.col("score"))
        return table(self.spark, self.at, "factory_passages").select("id", F.lower(F.regexp_replace("book_id", r"(?U)^\s+|\s+$", "")).alias("book_id"), "work_title", "text", "normalized_text", score.alias("score")).distinct()

    @property
    def items(self) -> DataFrame:
        v = F.col("vec_id")
        bounded = F.transform(F.slice("embedding", 1, 13), lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") + 0.5)))
        letter = lambda n: F.chr(F.lit(97) + n % 26)
        return self.embeddings.select(v.cast("string").alias("item"), F.concat(letter(v), letter(F.floor(v / 26))).alias("name"), bounded.alias("features"), F.concat(F.lit("s"), v % 40).alias("sound"), (v % 5).alias("book"), (v % 4).alias("relation"), F.col("label").alias("category"), (v % 6).alias("style"))

    @property
    def item_features(self) -> DataFrame:
        return self.items.select("item", "features")

    @property
    def reactions(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for x in ("purchase", "love", "signup", "like", "error", "dislike", "view", "skip")])
        rows = self.events.where("event_type <> 'click' and user_id is not null")
        return rows.select(F.col("user_id").alias("user"), (F.col("event_id") % 500).cast("string").alias("item"), F.get(F.array(kind[F.col("event_type")]), 0).alias("reaction"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))

    @property
    def shown(self) -> DataFrame:
        return self.events.where("event_type = 'click' and user_id is not null").select(F.col("user_id").alias("user"), (F.col("event_id") % 500).cast("string").alias("item"))

    @property
    def users(self) -> DataFrame:
        return preference.reaction_weights(self.reactions, self.item_features, 13)

    @property
    def people(self) -> DataFrame:
        """Every user of an event with the weights learnt so far, all 0 without a reaction."""
        seen = self.events.where("user_id is not null").select(F.col("user_id").alias("user")).distinct()
        return seen.join(self.users, "user", "left").select("user", F.coalesce("weights", F.array_repeat(F.lit(0.0), 13)).alias("weights"))

    @property
    def states(self) -> DataFrame:
        found = preference.states(self.people, self.reactions, pool.recent(self.reactions), self.shown)
        return found.repartition(shuffle_width(self.spark))

    @property
    def fits(self) -> DataFrame:
        return preference.fits(self.people, self.item_features, preference.explicit_feedback(self.reactions))


def _joined(column: str) -> Column:
    """A list as one text, for comparisons."""
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _choice() -> Column:
    """An answer without letter case and outer white space."""
    return F.lower(F.regexp_replace("choice", r"(?U)^\s+|\s+$", ""))


def _search(t: Tables) -> DataFrame:
    return search.search(t.name_queries, t.settled, t.corpus_books, t.aliases)


@query
def evidence_search(spark, sf_dir):
    return _search(Tables(spark, sf_dir))


@query
def evidence_citations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.citations(_search(t), t.settled, t.corpus_books)


@query
def evidence_grades(spark, sf_dir):
    return search.grade_counts(_search(Tables(spark, sf_dir)))


@query
def evidence_single_unit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    q = t.name_queries.select(F.col("u1").alias("query"), "u1", F.lit(None).cast("string").alias("u2"))
    return search.search(q, t.settled, t.corpus_books, t.aliases)


@query
def ordinals(spark, sf_dir):
    return index.ordinals(Tables(spark, sf_dir).settled)


@query
def posting_build(spark, sf_dir):
    return index.postings(Tables(spark, sf_dir).passages).withColumn("positions", _joined("positions"))


@query
def posting_rank(spark, sf_dir):
    return index.posting_ranks(Tables(spark, sf_dir).settled)


@query
def alias_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return index.alias_pairs(t.passages, t.char_aliases)


@query
def bucket_histogram(spark, sf_dir):
    return index.bucket_histogram(Tables(spark, sf_dir).passages)


@query
def sentence_split(spark, sf_dir):
    return Tables(spark, sf_dir).passages.select("id", F.posexplode(T.split_sentences(T.nfc(F.col("text")))).alias("n", "sentence"))


@query
def search_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.passages.select("id", T.search_text(F.col("text"), *t.aliases).alias("plain"))


@query
def indexed_render(spark, sf_dir):
    return Tables(spark, sf_dir).passages.where("normalized_text is not null").select("id", T.indexed_text(F.col("normalized_text")).alias("rendered"), T.indexed_length(F.col("normalized_text")).alias("size"))


@query
def corpus_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return quality.report(t.corpus_books, t.passages)


@query
def quality_issues(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return quality.issues(t.corpus_books, t.corpus_passages)


@query
def ready_gate(spark, sf_dir):
    return quality.coverage(Tables(spark, sf_dir).corpus_books)


@query
def citation_verify(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return quality.citation_issues(t.name_candidates, t.passages)


@query
def name_validation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fragments = t.passages.select("id", F.col("normalized_text").alias("quote"), F.col("chapter_title").alias("work_title"))
    return quality.name_validation(t.lexicon, fragments, t.name_candidates)


@query
def lexicon(spark, sf_dir):
    return Tables(spark, sf_dir).lexicon


@query
def mined_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mining.pairs(t.passages, t.corpus_books, t.lexicon, t.aliases)


@query
def discovery_pool(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mining.best_evidence(mining.pairs(t.passages, t.corpus_books, t.lexicon, t.aliases))


@query
def discovery_quota(spark, sf_dir):
    return mining.quota(discovery_pool(spark, sf_dir)).select("name", "grade", "score", "id", "picked", "place")


@query
def discovery_modes(spark, sf_dir):
    shown = discovery_pool(spark, sf_dir)
    a = F.col("grade") == "A"
    worth = (F.col("feminine") >= 4) & (F.col("usability") >= 3.5) & (F.substring("name", 1, 1) != F.substring("name", 2, 1))
    return shown.select("name", a.alias("a_only"), worth.alias("evidence"))


@query
def rule_screen(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = discovery_pool(spark, sf_dir).join(t.passages.select("id", "text"), "id")
    ok = (F.col("grade") == "A") & (F.substring("name", 1, 1) != F.substring("name", 2, 1)) & ~F.col("name").rlike(f"[{mining.SCREEN_FUNCTION}]") & ~F.col("text").rlike(f"[{mining.SCREEN_NEGATIVE}]")
    return rows.where(ok & (F.col("feminine") >= 4) & (F.col("rarity") >= 3.5) & (F.col("usability") >= 3.6)).select("name", "id", "score")


@query
def hash_sample(spark, sf_dir):
    return selection.hash_sample(discovery_pool(spark, sf_dir).select("name", "grade"), "name", 24, 7)


@query
def raw_pairs(spark, sf_dir):
    return mining.raw_pairs(Tables(spark, sf_dir).lexicon)


@query
def raw_filter(spark, sf_dir):
    found = mining.browse(mining.raw_pairs(Tables(spark, sf_dir).lexicon), feminine=4.0)
    return found.select("name", "feminine", "usability", "family")


@query
def interleave(spark, sf_dir):
    return mining.interleave(mining.raw_pairs(Tables(spark, sf_dir).lexicon))


@query
def allusion_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    quotes = t.name_candidates.select("id", T.simplified(F.col("quote"), *t.aliases).alias("quote"))
    return mining.allusions(quotes, t.lexicon)


@query
def clause_offsets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mining.clauses(t.factory, *t.aliases)


@query
def windows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mining.windows(t.factory, t.lexicon, t.aliases).select("id", "start", "end", "text", T.round_half_up(F.col("score"), 6).alias("score"), "opportunities", _joined("naming"))


def _nameability(t: Tables) -> DataFrame:
    return mining.nameability(t.factory, mining.windows(t.factory, t.lexicon, t.aliases), t.corpus_books)


@query
def nameability(spark, sf_dir):
    scored = _nameability(Tables(spark, sf_dir))
    return scored.select("id", T.round_half_up(F.col("score"), 6).alias("score"), _joined("naming"))


@query
def source_filter(spark, sf_dir):
    return Tables(spark, sf_dir).factory.where(mining.usable_source(F.col("text"), F.col("normalized_text"), F.col("score"))).select("id", "book_id", "score")


def _usable(t: Tables) -> DataFrame:
    """The passages that a selection by book may take: those without a book have no share in it."""
    return t.factory.where(F.col("book_id").isNotNull() & mining.usable_source(F.col("text"), F.col("normalized_text"), F.col("score")))


@query
def passage_pool(spark, sf_dir):
    return mining.selection_pool(_usable(Tables(spark, sf_dir)), 4)


@query
def mmr_passages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.diverse_passages(mining.selection_pool(_usable(t), 4), _nameability(t))


@query
def batches(spark, sf_dir):
    return mining.batches(mmr_passages(spark, sf_dir), 8)


@query
def capped_select(spark, sf_dir):
    score = F.coalesce("feminine", F.lit(0.0)) + F.coalesce("usability", F.lit(0.0)) + F.coalesce("rarity", F.lit(0.0))
    rows = Tables(spark, sf_dir).name_candidates.select(F.col("id").alias("item"), F.col("given_name").alias("name"), F.col("book_id").alias("book"), F.col("first_category").alias("category"), score.alias("score"))
    return selection.capped_selection(rows, 20)


@query
def pool_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    mined = discovery_pool(spark, sf_dir).select("name", F.concat(F.lit("mined:"), "name").alias("id"), F.col("id").alias("passage_id"), "grade", "feminine")
    curated = t.name_candidates.select(F.col("given_name").alias("name"), "id", "passage_id", "grade", "feminine")
    return pool.merge_by_name([mined, curated]).withColumn("citations", _joined("citations"))


@query
def culture_score(spark, sf_dir):
    rows = Tables(spark, sf_dir).name_candidates
    score = pool.weighted_score({"feminine": 5.0, "family_score": 3.0, "rarity": 3.0, "usability": 2.0}, F.col("grade").isin("A", "B"))
    return pool.competition_rank(rows.select("id", "given_name", score.alias("score")), "score").select("id", "given_name", "score", "rank")


@query
def features_auto(spark, sf_dir):
    return pool.features(Tables(spark, sf_dir).name_candidates).select("item", F.posexplode("features").alias("k", "value")).withColumn("value", T.round_half_up(F.col("value"), 9))


@query
def compare_pivot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chosen = [r[0] for r in t.name_candidates.orderBy("id").select("given_name").limit(3).collect()]
    named = dict(zip(chosen, ("n1", "n2", "n3")))
    rows = t.name_candidates.replace(named, subset=["given_name"])
    return pool.compare(rows, list(named.values()), ["grade", "category", "book_title", "quote", "work_title", "first_category", "second_category"])


@query
def scenarios(spark, sf_dir):
    return pool.scenarios(spark, "2026-10-01", "2026-10-11").withColumn("day", F.col("day").cast("string"))


@query
def page(spark, sf_dir):
    rows = mining.raw_pairs(Tables(spark, sf_dir).lexicon).select("name", "feminine", "usability")
    return selection.page(rows, [F.desc("feminine"), F.desc("usability"), F.asc("name")], 2, 48)


@query
def pointer_resolve(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.name_candidates.select("id", "passage_id", F.posexplode(T.characters(F.col("given_name"))).alias("n", "c"))
    at = names.join(t.passages.select(F.col("id").alias("passage_id"), "normalized_text"), "passage_id").select("id", "n", "passage_id", (F.instr("normalized_text", F.col("c")) - 1).alias("place"))
    return pool.pointers(at, t.passages)


@query
def reaction_fold(spark, sf_dir):
    users = Tables(spark, sf_dir).users
    return users.select("user", F.posexplode("weights").alias("k", "weight"), "events").withColumn("weight", T.round_half_up(F.col("weight"), 6))


@query
def reaction_stream(spark, sf_dir):
    """The streaming twin: the same weights, from the events as a stream."""
    t = Tables(spark, sf_dir)
    weights = stream.replay(spark, t.reactions, t.item_features, 13)
    return weights.select("user", F.posexplode("weights").alias("k", "weight"), "events").withColumn("weight", T.round_half_up(F.col("weight"), 6))


@query
def explicit_feedback(spark, sf_dir):
    return preference.explicit_feedback(Tables(spark, sf_dir).reactions)


@query
def exposure(spark, sf_dir):
    return preference.exposures(Tables(spark, sf_dir).shown).withColumn("penalty", T.round_half_up(F.col("penalty"), 9))


@query
def recent_items(spark, sf_dir):
    return pool.recent(Tables(spark, sf_dir).reactions)


@query
def list_toggles(spark, sf_dir):
    return pool.toggled(Tables(spark, sf_dir).shown)


@query
def fit(spark, sf_dir):
    return Tables(spark, sf_dir).fits.withColumn("fit", T.round_half_up(F.col("fit"), 6))


@query
def reasons(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = preference.reasons(t.people, t.item_features, None, [f"f{k:02d}" for k in range(13)])
    return out.select("user", "item", F.array_join("reasons", ",").alias("reasons"))


@query
def pairwise_fold(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.name_candidates.select(F.explode(F.array("given_name", "full_name")).alias("name"), F.col("given_name").alias("item"))
    rows = t.pairwise_feedback.groupBy("feedback_id").agg(F.min(F.struct("received_at", "profile_id", "left_name", "right_name", "choice", "recorded_at")).alias("f")).select("feedback_id", "f.*")
    sides = rows.join(names.select(F.col("name").alias("left_name"), F.col("item").alias("left")), "left_name").join(names.select(F.col("name").alias("right_name"), F.col("item").alias("right")), "right_name")
    choices = sides.where("profile_id is not null and left <> right").select(F.col("profile_id").alias("profile"), "left", "right", _choice().alias("choice"), F.col("recorded_at").alias("at"), F.col("feedback_id").alias("seq"))
    weights = preference.pairwise_weights(choices, pool.features(t.name_candidates), [0.0] * 13)
    return weights.select("profile", F.posexplode("weights").alias("k", "weight"), "progress").withColumn("weight", T.round_half_up(F.col("weight"), 6))


@query
def item_similarity(spark, sf_dir):
    """Similarity of the last six items of each user with each other."""
    t = Tables(spark, sf_dir)
    mine = pool.recent(t.reactions).join(t.items, "item")
    side = lambda p: mine.select("user", *[F.col(c).alias(f"{p}{c}") for c in t.items.columns])
    return side("a_").join(side("b_"), "user").where("a_item < b_item").select("user", "a_item", "b_item", T.round_half_up(selection.similarity("a_", "b_"), 9).alias("similarity"))


@query
def adaptive_next(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = selection.next_items(t.items, t.states)
    return out.withColumn("score", T.round_half_up(F.col("score"), 6))


@query
def mmr_batch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return selection.batches_of_all(t.items, t.states)


@query
def curated_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    source = F.concat(F.lit("《"), F.coalesce("book_title", F.lit("")), F.lit("·"), F.coalesce("work_title", F.lit("")), F.lit("》"))
    quotes = t.name_candidates.where("quote is not null").select("id", F.col("id").alias("seq"), source.alias("source"), T.simplified(F.col("quote"), *t.aliases).alias("quote"))
    return search.fragment_search(t.name_queries, quotes)


@query
def chunk_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.passages.select("id", F.posexplode(T.chunks(T.nfc(F.col("text")), *t.aliases)).alias("n", "chunk"))


@query
def outline_sections(spark, sf_dir):
    """The passages of every book written as an outline text and read again."""
    t = Tables(spark, sf_dir)
    line = F.concat(F.lit("*** "), F.col("work_title"), F.lit("\n"), F.regexp_replace("text", r"\s+", ""))
    books = t.passages.where("work_title is not null and work_title <> ''").groupBy("book_id", "work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", line.alias("line")))), lambda x: x.line).alias("lines"))
    files = books.select(F.col("work_id").alias("book_id"), F.concat(F.lit("#+TITLE: x\n** 卷\n"), F.array_join("lines", "\n")).alias("content"))
    return importers.outline_works(files, t.aliases).select("book_id", "n", "title", "chapter_title", F.get("segments", 0).alias("text"))


@query
def pack_shards(spark, sf_dir):
    rows = Tables(spark, sf_dir).passages.select("book_id", "id", "ord", "text", "normalized_text")
    return sinks.packed(rows, "book_id", ["ord", "id"], 64 * 1024).groupBy("book_id", "part").agg(F.count("*").alias("passages"), F.sum("bytes").alias("bytes"))


@query
def uneven_sources(spark, sf_dir):
    return sinks.uneven_sources(Tables(spark, sf_dir).passages)


@query
def stable_keys(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", jsontext.content_key(F.col("props")).alias("key"))


@query
def redacted(spark, sf_dir):
    return Tables(spark, sf_dir).documents.where("text is not null").select("doc_id", F.md5(jsontext.redacted(F.col("text"))).alias("digest"), jsontext.holds_secret(F.col("text")).alias("secret"))


@query
def pair_dedup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = mining.pairs(t.passages, t.corpus_books, t.lexicon, t.aliases)
    return pool.first_of(found, ["name", "grade", "book_id"], ["id", "distance"])


@query
def best_per_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = mining.pairs(t.passages, t.corpus_books, t.lexicon, t.aliases)
    worth = F.col("score") + F.when(F.col("grade") == "A", 0.15).otherwise(0.05)
    return pool.best_kept(found.withColumn("worth", worth), "name", [F.desc("worth"), F.asc("id"), F.asc("distance"), F.asc("grade")]).select("name", "id", "distance", "grade", "kept", "reason")


@query
def profile_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = t.pairwise_feedback.where("profile_id is not null").select(F.col("profile_id").alias("profile"), F.explode(F.array("left_name", "right_name")).alias("name")).distinct()
    return pool.by_either_name(named, t.name_candidates).select("profile", "id").distinct()


@query
def exclusion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    disliked = t.pairwise_feedback.where(_choice() == "both-dislike").select(F.explode(F.array("left_name", "right_name")).alias("name")).distinct()
    return pool.without(t.name_candidates, disliked).select("id")


@query
def dimension_lists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    count = lambda df, name: df.groupBy(F.col(df.columns[0]).alias("member")).agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "member", "n")
    units = t.name_candidates.select(F.explode(F.array("first_category", "second_category")).alias("c"))
    return count(t.corpus_books.select("category"), "category").unionByName(count(t.corpus_books.select("period"), "period")).unionByName(count(units, "unit category"))


@query
def raw_ids(spark, sf_dir):
    placed = place_within(mining.raw_pairs(Tables(spark, sf_dir).lexicon).select("name", "u1", "u2"), [], [F.asc("u1"), F.asc("u2")])
    return placed.select("name", F.format_string("RAW-%05d", "place").alias("raw_id"))


@query
def unit_interleave(spark, sf_dir):
    """The lexicon round-robin over its categories, cut to the size of the generating subset."""
    placed = place_within(Tables(spark, sf_dir).lexicon.select("unit", "category"), ["category"], [F.asc("unit")])
    return placed.select("unit", "category", (F.col("place") - 1).alias("turn")).orderBy("turn", "category").limit(560)


@query
def preliminary_topk(spark, sf_dir):
    """The best of a preliminary ranking: twice the target, and at least 20 more than it."""
    target = 30
    score = F.coalesce("feminine", F.lit(0.0)) + F.coalesce("rarity", F.lit(0.0)) + F.coalesce("usability", F.lit(0.0))
    placed = place_within(Tables(spark, sf_dir).name_candidates.select("id", score.alias("score")), [], [F.desc("score"), F.asc("id")])
    return placed.select("id", "place", (F.col("place") <= max(2 * target, target + 20)).alias("kept"))


@query
def profile_round_trip(spark, sf_dir):
    """Profiles written as JSON and read back with every field checked."""
    t = Tables(spark, sf_dir)
    weights = F.map_from_arrays(F.array(*[F.lit(f"f{k:02d}") for k in range(13)]), F.col("weights"))
    lists = preference.explicit_feedback(t.reactions).groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct("item", "signal"))).alias("explicit"))
    stored = t.users.join(lists, "user", "left").select("user", profiles.to_text(weights, F.col("explicit"), F.col("events")).alias("profile"))
    read = stored.select("user", profiles.parsed(F.col("profile"), [f"f{k:02d}" for k in range(13)]).alias("p"))
    return read.select("user", "p.progress", F.size("p.explicit").alias("explicit"), T.round_half_up(F.get("p.weights", 0), 6).alias("weight"))


from . import candidates  # noqa: E402, F401  (registers its queries)
