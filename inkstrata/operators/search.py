"""Evidence search: batches of one- and two-unit queries graded by how closely the units occur together.

A adjacent, B in one passage, C in one work, D in one book, E in two books, F a single unit. All grades come from
one pass over the passages: units that occur in a passage, and neighbours among them, meet the queries in the passage's own task, which
hands on its best few by query and grade (A, B, F) and its first two by query, side and work (C, and from its first ones D and E).
So what is shuffled depends on the queries and works, not on how often a unit occurs, and texts are joined only to what is shown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T
from inkstrata.session import checkpointed

from . import index

#: How many matches of a grade a query shows.
LIMITS = {"A": 8, "B": 8, "C": 6, "D": 6, "E": 6, "F": 8}

#: Queries that are answered in one pass over the passages; each task holds them.
BLOCK = 50_000
_FOUND = "query string, grade string, kind string, side int, id string, book_ord bigint, work_ord bigint, rank bigint, passage_ord bigint"
_KINDS = np.array(["adjacent", "reversed", "apart", ""], object)
_GRADES = np.array(["A", "B", "F0", "F1", "F2"], object)


def _leading(groups: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """The places of the first ``n`` of each group by order."""
    line = np.lexsort((order, groups))
    sorted_ = groups[line]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(line) else np.zeros(0, np.int64)
    turn = np.arange(len(line)) - np.repeat(starts, np.diff(np.r_[starts, len(line)]))
    return line[turn < n]


def _evidence(names: list[str], first: np.ndarray, second: np.ndarray):
    """Passages against a block of queries: ``first`` and ``second`` have the code points of each query's units, 0 for none."""
    by = [np.argsort(side, kind="stable") for side in (first, second)]
    sorted_ = [side[order] for side, order in zip((first, second), by)]
    title = np.array(names, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0x110000, bool)
        known[first], known[second], known[0] = True, True, False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            lengths = np.array([len(t) for t in texts], np.int64)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            mine = known[points]
            near = np.flatnonzero(mine[:-1] & mine[1:] & (rows[:-1] == rows[1:])) if len(points) else np.zeros(0, np.int64)
            neighbours = np.unique((rows[near] << 42) | (points[near] << 21) | points[near + 1])
            at = np.flatnonzero(mine)
            held, counts = np.unique((rows[at] << 21) | points[at], return_counts=True)
            row, point = held >> 21, held & 0x1FFFFF

            def met(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Query, row and count of every unit of a side that occurs."""
                low, high = np.searchsorted(sorted_[side], point), np.searchsorted(sorted_[side], point, side="right")  # noqa: B023
                times = high - low
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                return by[side][np.repeat(low, times) + offset], np.repeat(row, times), np.repeat(counts, times)  # noqa: B023

            (qa, ra, na), (qb, rb, _) = met(0), met(1)
            columns = [batch.column(i) for i in range(1, batch.num_columns)]
            book, work, place, rank = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[1:])
            size = len(lengths) + 1
            ka, kb = qa * size + ra, qb * size + rb
            lone = ~np.isin(kb, ka)
            query, own, count = np.r_[qa, qb[lone]], np.r_[ra, rb[lone]], np.r_[na, np.zeros(lone.sum(), np.int64)]
            both, twice = np.r_[np.isin(ka, kb), np.zeros(lone.sum(), bool)], first[query] == second[query]
            pair = lambda a, b: np.isin((own << 42) | (a << 21) | b, neighbours)  # noqa: B023, E731
            forward, backward = pair(first[query], second[query]), pair(second[query], first[query])
            kind = np.select([both & ~twice & forward, both & ~twice & backward, both & ~twice, twice & (count > 1) & forward, twice & (count > 1)], [0, 1, 2, 0, 2], 3)
            grade = np.select([kind == 0, kind < 3, (second[query] == 0) | twice, count > 0], [0, 1, 2, 3], 4)
            order = (rank[own] << 44) | place[own]
            best = _leading(query * 5 + grade, order, 8)
            yield _rows(title, query[best], _GRADES[grade[best]], _KINDS[kind[best]], np.zeros(len(best), np.int32), own[best], columns)
            two = second[qa] != 0
            query, own, side = np.r_[qa[two], qb], np.r_[ra[two], rb], np.r_[np.ones(two.sum(), np.int32), np.full(len(qb), 2, np.int32)]
            best = _leading(np.unique(np.stack([query, side, work[own]]), axis=1, return_inverse=True)[1].ravel() if len(query) else query, (rank[own] << 44) | place[own], 2)
            yield _rows(title, query[best], np.full(len(best), "W", object), np.full(len(best), "", object), side[best], own[best], columns)

    return run


def _rows(title, query, grade, kind, side, own, columns) -> pa.RecordBatch:
    ids, book, work, place, rank = (c.take(pa.array(own)) for c in columns)
    return pa.record_batch(
        [pa.array(title[query], pa.string()), pa.array(grade, pa.string()), pa.array(kind, pa.string()), pa.array(side, pa.int32()), ids, book.cast(pa.int64()), work.cast(pa.int64()), rank.cast(pa.int64()), place.cast(pa.int64())],
        names=[f.split()[0] for f in _FOUND.split(", ")],
    )


def _first(df: DataFrame, keys: list[str], order: list, n: int, name: str = "i") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def search(queries: DataFrame, passages: DataFrame, books: DataFrame, aliases: tuple[str, str]) -> DataFrame:
    """``query, grade, place, kind, id_a, id_b`` of every match.

    ``queries`` has ``query, u1, u2`` (u2 null for one unit), units normalised. place is the match's place in its grade, id_b the
    second passage of C, D and E. A match of grade A whose book isn't punctuated, or whose units aren't neighbours in the stored
    text, is shown in B, before the other B.
    """
    q = queries.distinct().orderBy("query", "u1", "u2").toPandas()  # the batch of the caller
    code = lambda c: np.array([ord(u) if isinstance(u, str) and len(u) == 1 else 0 for u in q[c]], np.int64)
    first, second = code("u1"), code("u2")
    ranked = index.ranked_passages(passages).where("normalized_text <> ''").select("normalized_text", "id", "book_ord", "work_ord", "passage_ord", "rank")
    evidence = None
    for k in range(0, max(1, len(q)), BLOCK):
        part = ranked.mapInArrow(_evidence(q["query"].tolist()[k : k + BLOCK], first[k : k + BLOCK], second[k : k + BLOCK]), _FOUND)
        evidence = part if evidence is None else evidence.unionByName(part)
    evidence = checkpointed(evidence).withColumn("at", F.struct("rank", "passage_ord"))
    two = passages.sparkSession.createDataFrame([(x, a, b) for x, a, b in zip(q["query"], q["u1"], q["u2"]) if isinstance(b, str)], "query string, u1 string, u2 string")
    found = _first(evidence.where("grade <> 'W'"), ["query", "grade"], ["at"], 8)
    ab = found.where("grade in ('A', 'B')").select("query", "grade", "i", "kind", F.col("id").alias("id_a"))
    texts = passages.join(books.select(F.col("id").alias("book_id"), F.col("source.segmentation").alias("segmentation")), "book_id", "left").select(F.col("id").alias("id_a"), "segmentation", T.simplified(F.col("text"), *aliases).alias("plain"))
    direct = F.coalesce((F.col("segmentation") == "punctuated") & (F.instr(F.col("plain"), F.concat("u1", "u2")) > 0), F.lit(False))
    shown = ab.join(two, "query").join(texts, "id_a").withColumn("shown", F.when((F.col("grade") == "A") & ~direct, "B").otherwise(F.col("grade")))
    place = F.row_number().over(Window.partitionBy("query", "shown").orderBy("grade", "i"))
    ab = shown.select("query", F.col("shown").alias("grade"), place.alias("place"), F.when(F.col("shown") == F.col("grade"), F.col("kind")).otherwise("adjacent, not direct").alias("kind"), "id_a", F.lit(None).cast("string").alias("id_b"))
    lone = found.where(f"grade = 'F0' or grade in ('F1', 'F2') and i <= {LIMITS['F'] // 2}")
    f = lone.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("grade", "i"))).select("query", F.lit("F").alias("grade"), "place", F.col("id").alias("id_a"), F.lit(None).cast("string").alias("id_b"))

    # By work: the first two postings of either side; books and pairs of books take theirs from these.
    works = _first(evidence.where("grade = 'W'"), ["query", "side", "work_ord"], ["at"], 2)

    def paired(rows: DataFrame, keys: list[str], apart: str) -> DataFrame:
        """The first pair, in the order of the left then of the right postings, that differs in ``apart``."""
        x = rows.where("side = 1").select(*keys, F.col("i").alias("ia"), F.col("id").alias("id_a"), F.col(apart).alias("xa"))
        y = rows.where("side = 2").select(*keys, F.col("i").alias("ib"), F.col("id").alias("id_b"), F.col(apart).alias("xb"))
        pairs = x.join(y, keys).where("xa <> xb")
        return pairs.groupBy(*keys).agg(F.min(F.struct("ia", "ib", "id_a", "id_b")).alias("p")).select(*keys, "p.id_a", "p.id_b")

    c = _first(paired(works, ["query", "work_ord"], "passage_ord"), ["query"], [F.col("work_ord").cast("string")], LIMITS["C"], "place").withColumn("grade", F.lit("C"))
    heads = checkpointed(_first(works.where("i = 1").drop("i"), ["query", "side", "book_ord"], ["at"], 2))
    d = _first(paired(heads, ["query", "book_ord"], "work_ord"), ["query"], [F.col("book_ord").cast("string")], LIMITS["D"], "place").withColumn("grade", F.lit("D"))
    # The first pairs in order of both books lie among the first few books of either side.
    few = _first(heads.where("i = 1").select("query", "side", "book_ord", "id"), ["query", "side"], [F.col("book_ord").cast("string")], LIMITS["E"] + 1)
    book = lambda n, i: few.where(F.col("side") == n).select("query", F.col("book_ord").alias(f"b{n}"), F.col("id").alias(i))
    e = _first(book(1, "id_a").join(book(2, "id_b"), "query").where("b1 <> b2"), ["query"], [F.col("b1").cast("string"), F.col("b2").cast("string")], LIMITS["E"], "place").withColumn("grade", F.lit("E"))
    kinds = {"C": "one work", "D": "one book", "E": "two books", "F": "single"}
    rest = [x.select("query", "grade", "place", F.lit(kinds[g]).alias("kind"), "id_a", "id_b") for g, x in zip("CDEF", (c, d, e, f))]
    return ab.unionByName(rest[0]).unionByName(rest[1]).unionByName(rest[2]).unionByName(rest[3])


def citations(matches: DataFrame, passages: DataFrame, books: DataFrame) -> DataFrame:
    """One row for every passage a match cites, with its text and book; a missing passage raises, a missing book falls back to its id."""
    cited = matches.select("query", "grade", "place", F.posexplode(F.array_compact(F.array("id_a", "id_b"))).alias("n", "id"))
    shelf = books.select(F.col("id").alias("book_id"), "title", "category")
    found = cited.join(passages.select("id", "book_id", "work_title", "chapter_title", "text", "source_url", "verification_url", F.lit(True).alias("_known")), "id", "left").join(shelf, "book_id", "left")
    there = F.when(F.col("_known").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no passage: "), "id")))
    return found.select("query", "grade", "place", "n", there.alias("id"), "book_id", F.coalesce("title", "book_id").alias("book_title"), F.coalesce("category", F.lit("古籍")).alias("category"), "work_title", "chapter_title", "text", "source_url", "verification_url")


def grade_counts(matches: DataFrame) -> DataFrame:
    """Matches of each grade and of the groups of grades, per query."""
    n = lambda grades: F.count_if(F.col("grade").isin(*grades))
    return matches.groupBy("query").agg(*[n([g]).alias(f"n_{g.lower()}") for g in LIMITS], n(list("ABC")).alias("n_abc"), n(list("DE")).alias("n_de"))


def fragment_search(queries: DataFrame, fragments: DataFrame, most: int = 12) -> DataFrame:
    """Evidence in a hand-kept set of quotations: ``query, grade, id_a, id_b``.

    ``queries`` has query, u1, u2; ``fragments`` has id, seq (the order), source, quote. A together, B in one quote, C in one source
    that has no quote with both, D in two sources of one family, E in two families, F one unit only. D and E take of each source
    the first quote that has only the one unit, and show the first ``most`` pairs by the order of both sides.
    """
    units = fragments.select("id", "seq", "source", "quote", T.source_family(F.col("source")).alias("family"), F.explode(F.array_distinct(T.characters(F.col("quote")))).alias("unit"))
    hit = lambda n: queries.join(units, F.col(f"u{n}") == F.col("unit")).drop("unit").withColumn(f"has{n}", F.lit(True))
    keys = ["query", "u1", "u2", "id", "seq", "source", "quote", "family"]
    both = hit(1).unionByName(hit(2), allowMissingColumns=True).groupBy(*keys).agg(F.coalesce(F.max("has1"), F.lit(False)).alias("h1"), F.coalesce(F.max("has2"), F.lit(False)).alias("h2"))
    both = checkpointed(both)
    two = F.col("h1") & F.col("h2") & F.col("u2").isNotNull()
    joined = F.instr("quote", F.concat("u1", "u2")) > 0
    twice = F.col("u1").eqNullSafe(F.col("u2"))
    grade = F.when(two & joined, "A").when(two & ~twice, "B").otherwise("F")
    own = both.select("query", grade.alias("grade"), F.col("id").alias("id_a"), F.lit(None).cast("string").alias("id_b"))

    pairs = both.where("u2 is not null")
    at = lambda h: F.min(F.when(F.col(h), F.struct("seq", "id")))
    sources = pairs.groupBy("query", "source").agg(F.max(F.col("h1") & F.col("h2")).alias("whole"), at("h1").alias("a"), at("h2").alias("b")).where("not whole and a is not null and b is not null and a.id <> b.id")
    c = sources.select("query", F.lit("C").alias("grade"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))

    def lone(has: str, lacks: str, x: str) -> DataFrame:
        first = pairs.where(f"{has} and not {lacks}").groupBy("query", "family", "source").agg(F.min(F.struct("seq", "id")).alias("k")).select("query", "family", "source", "k.seq", "k.id")
        return first.select("query", *[F.col(c).alias(f"{c}_{x}") for c in ("family", "source", "seq", "id")])

    a, b = lone("h1", "h2", "a"), lone("h2", "h1", "b")

    def few(side: DataFrame, x: str) -> DataFrame:
        """All that the first pairs of two families can need: the first of each family, of the first families."""
        first = _first(side, ["query", f"family_{x}"], [F.col(f"seq_{x}")], most)
        heads = _first(first.where("i = 1").select("query", f"family_{x}", f"seq_{x}"), ["query"], [F.col(f"seq_{x}")], most + 1, "j")
        return first.join(heads.select("query", f"family_{x}"), ["query", f"family_{x}"], "left_semi")

    order = [F.col("seq_a"), F.col("seq_b")]
    near = a.withColumnRenamed("family_a", "family").join(b.withColumnRenamed("family_b", "family"), ["query", "family"]).where("source_a <> source_b")
    far = few(a, "a").drop("i").join(few(b, "b").drop("i"), "query").where("family_a <> family_b")
    shown = lambda df, g: _first(df, ["query"], order, most).select("query", F.lit(g).alias("grade"), "id_a", "id_b")
    return own.unionByName(c).unionByName(shown(near, "D")).unionByName(shown(far, "E"))
