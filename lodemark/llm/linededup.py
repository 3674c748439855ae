"""Line dedup through a deletion-neighbourhood join. DataFrame functions only.

Two lines are alike at an edit distance of EDITS = 1 at most: one character put in, left out or replaced. Every line alike
to another shares a hashed variant with it: both without the character at the same place, or one whole and the other
without a character. Variants are joined by equal hashes and the edit distance is verified on the texts.

A line has as many variants as characters, so those are emitted only where a partner can be: if one character differs, all
segments of the line but one agree, at the front counted from the start and at the back counted from the end. Lines are
first held together by halves, what is left by sixteenths, and deletions are emitted inside the segments that may differ.
Both filters lose no pair. What surrounds a segment is hashed once, so a variant costs no more than the segment it is made
of. A group of equal variants holds one line for each character that can stand in the one place, so it is bounded by the
alphabet and never by the number of rows; each line is linked to the earliest of its group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.llm.common import cut, drop_cut, free

EDITS = 1
#: Shorter lines are kept as they are: a greeting or a list mark that comes again isn't a copy.
LEAST_CHARS = 20
#: Segments of the first and of the second filter.
COARSE, FINE = 2, 16
LAST = (1 << 63) - 1


def _segments(line: Column, count: int) -> Column:
    """An array of (key, m, g): the line without its segment g, cut at parts of m, for m its length and its length less one."""
    size = F.char_length(line)
    found = []
    for shorter in (0, 1):
        m = size - F.lit(shorter)
        for g in range(count):
            begin, end = F.floor(m * g / count).cast("int"), F.floor(m * (g + 1) / count).cast("int")
            back = m - end
            key = F.xxhash64(F.lit(g), m, F.substring(line, F.lit(1), begin), F.substring(line, size - back + 1, back))
            found.append(F.struct(key.alias("key"), m.alias("m"), F.lit(g).alias("g")))
    return F.array(*found)


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, h1, ...) whose key more than one line has."""
    good = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    return keys.join(good, "key", "left_semi")


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    lines = docs.select("k", "d", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(F.char_length("line") >= least_chars)
    return lines.select("k", "d", "n", "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _near(docs: DataFrame, occurrences: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of lines that an earlier line is one edit away from."""
    coarse = cut(_shared(occurrences.select("h1", F.explode(_segments(F.col("line"), COARSE)["key"]).alias("key"))).select("h1").distinct(), "coarse")
    places = firsts.join(coarse, "h1").select("h1", "h2", "first")
    lines = cut(
        docs.join(places.withColumns({"d": F.col("first.d"), "k": F.col("first.k")}), ["d", "k"]).select("h1", "h2", "first", F.get(F.split("text", "\n", -1), F.col("first.n")).alias("line")).dropDuplicates(["h1", "h2"]),
        "lines",
    )
    drop_cut(coarse)
    fine = _shared(lines.select("h1", "h2", F.explode(_segments(F.col("line"), FINE)).alias("e")).select("h1", "h2", "e.*"))
    parts = fine.groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "m", "g")).alias("parts"))  # 2 * FINE at most
    lines_left = cut(lines.join(parts, ["h1", "h2"]), "fine")
    size, m, g = F.char_length("line"), F.col("p.m"), F.col("p.g")
    begin, end = F.floor(m * g / FINE).cast("int"), F.floor(m * (g + 1) / FINE).cast("int")
    whole, back = m == size, m - end
    at = lines_left.select("h1", "h2", "first", "line", F.explode("parts").alias("p"))
    # what is around the segment, by a second hash of its own, and the segment, a character longer where one may be left out
    around = F.hash("p.key", F.substring("line", F.lit(1), begin), F.substring("line", size - back + 1, back))
    at = at.select("h1", "h2", "first", "p.key", around.alias("around"), whole.alias("whole"), F.substring("line", begin + 1, size - back - begin).alias("segment"))
    length = F.char_length("segment")
    each = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    left = F.concat(F.substring("segment", F.lit(1), F.col("i")), F.substring("segment", F.col("i") + 2, length))

    def variant(rest: Column, i: Column, uncut: bool) -> list[Column]:
        return [F.xxhash64("key", "around", rest).alias("v"), F.hash("around", "key", rest).alias("v2"), i.alias("i"), F.lit(uncut).alias("w")]

    variants = at.withColumn("i", F.explode(each)).select("h1", "h2", "first", *variant(left, F.when(F.col("whole"), F.col("i")).otherwise(F.lit(-1)), False))
    variants = variants.union(at.where("whole").select("h1", "h2", "first", *variant(F.col("segment"), F.lit(-1), True))).distinct()
    group = Window.partitionBy("v", "v2", "i")
    me = F.struct("first", "h1", "h2")
    # replaced: all of a group are alike; put in or left out: the one whole line is alike to each of the others
    partner = F.when(F.col("i") >= 0, F.min(me).over(group)).when(F.col("w"), F.min(F.when(~F.col("w"), me)).over(group)).otherwise(F.min(F.when(F.col("w"), me)).over(group))
    found = variants.withColumn("e", partner).where(F.col("e.first") < F.col("first")).select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    mine, other = lines_left.select("h1", "h2", "line"), lines_left.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("earlier"))
    alike = found.join(mine, ["h1", "h2"]).join(other, ["e1", "e2"]).where(F.levenshtein("line", "earlier", EDITS).between(0, EDITS))
    return alike.select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of text_col that came before left out, and n_lines and n_dropped.

    Lines are what lies between line feeds, in order of id and place. Of equal lines the earliest stays; a line also goes
    if a line that came earlier is one edit away. Lines below least_chars characters stay. Null texts stay null (0 lines),
    empty texts are one empty line, lines and texts of any length are read whole; a null id comes after all others; rows
    alike in id and text share one decision. Extra columns stay as they are, whatever their names; columns n_lines and
    n_dropped of the input are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    id_of, text_of = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(text_col)
    # a document is its id and its text's hash: two documents are taken for one only if they have the id in common as well
    slim = docs.select(text_of.alias("k"), id_of.alias("d"), F.col(text_col).alias("text"))
    occurrences = _occurrences(slim, least_chars)
    firsts = cut(occurrences.groupBy("h1", "h2").agg(F.min(F.struct("d", "n", "k")).alias("first"), F.count("*").alias("often")), "firsts")
    near = cut(_near(slim, occurrences, firsts).withColumn("near", F.lit(True)), "near")
    concerned = firsts.join(near, ["h1", "h2"], "left").where("often > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    later = occurrences.select("k", "d", "n", "h1", "h2").join(concerned, ["h1", "h2"]).where(F.col("near") | (F.struct("d", "n", "k") != F.col("first")))
    k, d, gone = free(docs.columns, "k", "d", "gone")
    left_out = cut(later.groupBy(F.col("k").alias(k), F.col("d").alias(d)).agg(F.collect_set("n").alias(gone)), "gone")
    lines = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    out = docs.withColumns({k: text_of, d: id_of}).join(left_out, [k, d], "left")
    left = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    counted = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return counted.withColumn(text_col, left).select(*(F.col(f"`{c}`") for c in docs.columns), "n_lines", "n_dropped")


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    """doc_id, its lines, how many went, and bytes and MD5 of the text that stays."""
    docs = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "n_lines", "n_dropped", F.octet_length(text).cast("long").alias("kept_bytes"), F.md5(text.cast("binary")).alias("kept_md5"))


OP6_SQL = """
WITH o AS (
  SELECT doc_id, text, n, lines[n] AS line FROM (
    SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents))),
f AS (SELECT line, min((doc_id, n)) AS first FROM o WHERE length(line) >= 20 GROUP BY line),
c AS (
  SELECT a.line AS line, b.line AS earlier FROM f a JOIN f b ON left(a.line, 10) = left(b.line, 10) AND abs(length(a.line) - length(b.line)) <= 1 AND b.first < a.first
  UNION
  SELECT a.line, b.line FROM f a JOIN f b ON right(a.line, 10) = right(b.line, 10) AND abs(length(a.line) - length(b.line)) <= 1 AND b.first < a.first),
near AS (
  SELECT DISTINCT line FROM c WHERE len(list_filter(range(1, greatest(length(line), length(earlier)) + 1), lambda i:
    substr(line, 1, i - 1) = substr(earlier, 1, i - 1) AND (
      (length(line) = length(earlier) AND substr(line, i + 1) = substr(earlier, i + 1))
      OR (length(line) > length(earlier) AND substr(line, i + 1) = substr(earlier, i))
      OR (length(line) < length(earlier) AND substr(line, i) = substr(earlier, i + 1))))) > 0),
m AS (
  SELECT o.doc_id, o.n, o.line, length(o.line) < 20 OR (near.line IS NULL AND f.first = (o.doc_id, o.n)) AS stays
  FROM o LEFT JOIN f ON o.line = f.line LEFT JOIN near ON o.line = near.line),
t AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (stays), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, CAST(strlen(kept) AS BIGINT) AS kept_bytes, md5(kept) AS kept_md5 FROM t
"""
