"""Importers: three source formats to passages, and the gates before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T

_WORK = "struct<title:string,rhythmic:string,chapter:string,section:string,author:string,content:array<string>,paragraphs:array<string>>"
_VOLUME = "struct<title:string,content:array<struct<chapter:string,title:string,paragraphs:array<string>>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of text files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def joined_parts(files: DataFrame, pattern: str) -> DataFrame:
    """The files whose path matches, in the order of their paths, as one outline text with a heading for each."""
    listed = files.where(F.col("path").rlike(pattern)).select(F.struct("path", "content").alias("f"))
    return listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(F.lit("** "), f.path, F.lit("\n"), f.content)), "\n").alias("content"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def unlocked(found: DataFrame, lock: DataFrame) -> DataFrame:
    """``path, reason`` of files that differ from the lock (path, sha256), are not in it or are missing: empty means the gate is open."""
    both = found.withColumnRenamed("sha256", "now").join(lock.withColumnRenamed("sha256", "then"), "path", "full")
    reason = F.when(F.col("then").isNull(), "not locked").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", reason.alias("reason")).where("reason is not null")


def _clean(column: Column) -> Column:
    trimmed = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def _segments(column: Column) -> Column:
    return F.when(column.isNotNull(), F.filter(F.transform(column, _clean), lambda s: s.isNotNull()))


def anthology_works(files: DataFrame) -> DataFrame:
    """``book_id, n, title, chapter_title, segments`` from JSON of several shapes; ``n`` from 0.

    ``files`` has ``book_id, content``. An array's elements must all be works with content, else all works with paragraphs under a
    chapter, else all poems; an object is one work with paragraphs or an anthology of volumes. Anything else raises.
    """
    raw = files.withColumn("list", F.from_json(F.when(F.col("content").rlike(r"^\s*\["), F.col("content")), f"array<{_WORK}>"))
    raw = raw.withColumn("single", F.from_json(F.when(F.col("content").rlike(r"^\s*\{"), F.col("content")), "struct<chapter:string,paragraphs:array<string>>"))
    raw = raw.withColumn("volumes", F.from_json(F.when(F.col("content").rlike(r"^\s*\{"), F.col("content")), f"struct<content:array<{_VOLUME}>>"))
    work = lambda title, chapter, segments: F.struct(title.alias("title"), chapter.alias("chapter_title"), segments.alias("segments"))
    whole = lambda w: w.title.isNotNull() & w.segments.isNotNull()

    def with_content(w: Column) -> Column:
        title = _clean(w.title)
        inner = F.array_join(F.filter(F.array(_clean(w.chapter), _clean(w.section)), lambda c: c.isNotNull()), "·")
        return work(title, F.when(inner != "", inner).otherwise(title), _segments(w.content))

    def with_chapter(w: Column) -> Column:
        return work(_clean(w.chapter), _clean(w.chapter), _segments(w.paragraphs))

    def poem(w: Column) -> Column:
        title, author = F.coalesce(_clean(w.title), _clean(w.rhythmic)), _clean(w.author)
        return work(title, F.when(author.isNotNull(), F.concat_ws("·", author, title)).otherwise(title), _segments(w.paragraphs))

    shapes = [F.transform("list", f) for f in (with_content, with_chapter, poem)]
    one = F.array(with_chapter(F.col("single")))
    flat = F.flatten(F.transform("volumes.content", lambda v: F.transform(v.content, lambda w: work(F.coalesce(_clean(w.chapter), _clean(w.title)), F.coalesce(_clean(v.title), F.lit("选篇")), _segments(w.paragraphs)))))
    # a null list makes forall null, and the next shape is tried
    choice = F.when(F.col("list").isNotNull() & F.forall(shapes[0], whole), shapes[0]).when(F.col("list").isNotNull() & F.forall(shapes[1], whole), shapes[1]).when(F.col("list").isNotNull() & F.forall(shapes[2], whole), shapes[2])
    choice = choice.when(F.col("list").isNull() & F.forall(one, whole), one).when(F.col("list").isNull() & F.forall(flat, whole) & (F.size(flat) > 0), flat).otherwise(F.raise_error(F.concat(F.lit("unknown source structure: "), "book_id")))
    return raw.select("book_id", F.posexplode(choice).alias("n", "w")).select("book_id", "n", "w.*")


def line_works(files: DataFrame) -> DataFrame:
    """The same columns from JSON lines with the strings id, series and text: a line is a work of one segment.

    Blank lines are passed over; a bad line raises with its number among the others, and so does a file without lines.
    """
    lines = F.filter(F.split("content", r"\r?\n"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != "")
    listed = files.select("book_id", F.when(F.size(lines) > 0, lines).otherwise(F.raise_error(F.concat(F.lit("no text: "), "book_id"))).alias("lines"))
    rows = listed.select("book_id", F.posexplode("lines").alias("n", "line")).withColumn("row", F.from_json("line", "id string, series string, text string"))
    ok = F.col("row.id").isNotNull() & F.col("row.series").isNotNull() & F.col("row.text").isNotNull()
    checked = F.when(ok, F.col("row.id")).otherwise(F.raise_error(F.format_string("%s: line %d is not valid", "book_id", F.col("n") + 1)))
    return rows.select("book_id", "n", checked.alias("title"), F.col("row.id").alias("chapter_title"), F.array("row.text").alias("segments"))


def outline_works(files: DataFrame, aliases: tuple[str, str], section: str | None = None) -> DataFrame:
    """The same columns from outline texts: headings of two or more stars, body lines joined without a separator.

    ``files`` has ``book_id, content``. A heading of two stars names the chapter, every heading the work. Sections without
    searchable characters are left out. With ``section`` only the first whose title has it stays.
    """
    lines = files.select("book_id", F.posexplode(F.split("content", r"\r?\n")).alias("k", "line")).withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    lines = lines.where("line <> '' and not startswith(line, '#+')")
    stars = F.regexp_extract("line", r"^(\*{2,})\s+(?:\d+\s+)?(.+)$", 1)
    named = lines.withColumn("stars", F.char_length(stars)).withColumn("name", F.when(F.col("stars") > 0, F.trim(F.regexp_extract("line", r"^(\*{2,})\s+(?:\d+\s+)?(.+)$", 2))))
    line = Window.partitionBy("book_id").orderBy("k")
    placed = named.select("book_id", "k", "line", "stars", F.count_if(F.col("stars") > 0).over(line).alias("part"), F.last("name", True).over(line).alias("title"), F.last(F.when(F.col("stars") == 2, F.col("name")), True).over(line).alias("chapter"))
    body = placed.where("stars = 0").groupBy("book_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line), "").alias("text"), F.min("title").alias("title"), F.min("chapter").alias("chapter"))
    kept = body.where(F.char_length(T.search_text(F.col("text"), *aliases)) > 0)
    if section is not None:
        kept = kept.where(F.contains(F.col("title"), F.lit(section)))
        kept = kept.join(kept.groupBy("book_id").agg(F.min("part").alias("part")), ["book_id", "part"], "left_semi")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("part")) - 1
    return kept.select("book_id", n.alias("n"), F.coalesce("title", "book_id").alias("title"), F.coalesce("chapter", "book_id").alias("chapter_title"), F.array("text").alias("segments"))


def passages(works: DataFrame, aliases: tuple[str, str], source_url: str, verification_url: str, chunked: bool = False) -> DataFrame:
    """Passages of works: sentences, or chunks of them, that have searchable characters.

    Chapters are numbered by first appearance in a book, passages within a work, ``ord`` within a book.
    """
    composed = works.select("book_id", "n", "title", "chapter_title", F.posexplode("segments").alias("s", "segment")).withColumn("segment", T.nfc(F.col("segment")))
    cut = T.chunks(F.col("segment"), *aliases) if chunked else T.split_sentences(F.col("segment"))
    rows = composed.select("book_id", "n", "title", "chapter_title", "s", F.posexplode(cut).alias("k", "text")).withColumn("normalized_text", T.han_only(T.simplified(F.col("text"), *aliases))).where("normalized_text <> ''")
    book = Window.partitionBy("book_id")
    first = F.min("n").over(Window.partitionBy("book_id", "chapter_title"))
    rows = rows.withColumn("first", first).withColumn("chapter", F.dense_rank().over(book.orderBy("first", "chapter_title"))).withColumn("ord", F.row_number().over(book.orderBy("n", "s", "k"))).withColumn("p", F.row_number().over(Window.partitionBy("book_id", "n").orderBy("s", "k")))
    work_id = F.format_string("%s/work-%04d", "book_id", F.col("n") + 1)
    chapter_id = F.format_string("%s/chapter-%04d", "book_id", F.col("n") + 1 if chunked else F.col("chapter"))
    return rows.select(F.concat(work_id, F.format_string("/passage-%04d", "p")).alias("id"), "book_id", work_id.alias("work_id"), chapter_id.alias("chapter_id"), F.col("title").alias("work_title"), "chapter_title", "ord", "text", "normalized_text", F.lit(source_url).alias("source_url"), F.lit(verification_url).alias("verification_url"))
