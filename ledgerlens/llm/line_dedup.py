"""Line dedup by winnowing over line hashes.

A document is its sequence of lines, blank ones aside, ends trimmed of spaces.

A line goes exactly if it lies in a *run* that stood earlier (by doc_id, then line): RUN
consecutive lines, or fewer of which one has ``LONG`` characters or more.

1. *Select*: in every window of ``RUN`` consecutive lines the line of the smallest hash
   (the first 60 bits of its md5; the rightmost of equal ones) is the fingerprint. Two
   equal windows select the same line. Windows of fewer lines with a long one have it as
   theirs. A window that shorter ones with long lines cover is left out: both of them go
   where it goes, so a text of long lines has one name a line.
2. *Join positions*: a fingerprint's position has the windows that selected it as its
   names. Under each name every later position meets the first one (by doc_id, then
   line), so a line that a third of all documents share gives one row for each of them,
   and no pairs. A window that stood earlier anywhere meets its own first copy, whatever
   surrounds other copies of its fingerprint.
3. *Extend*: from such a pair of positions the match grows both ways, line by line, as long
   as the two documents agree, through the lines that windows around the position reach
   (RUN - 1 either way). A run that goes on has a fingerprint in every further window, which
   stood earlier as well and grows from there, so a run of any length is grown whole. Positions
   have the lines around them with them: no document is fetched for a pair, and a document of n
   repeated lines is n pieces of fixed size, not n comparisons of all its lines.
4. *Delete*: a matched run of RUN lines or more, or one that holds a long line, goes from
   the later document whole. The first copy of a line never goes, as what goes has an
   equal line before it.

Only DataFrame functions are used. Defined cases: a null text stays null with 0
lines, an empty text is empty; blank lines stay where they are and take no part;
repeated rows (equal id and text) are one document and give equal results;
documents of one id with different texts are ordered by a hash of the text; a null
id is ordered before all others; an empty table gives an empty table; other columns
are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, table

RUN = 3
LONG = 40
#: Lines either way of a position that the windows which hold it can reach.
REACH = RUN - 1


def _hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _is_long(mark: Column) -> Column:
    return F.coalesce(mark.bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, marks: twice the hash of a line, plus 1 for a long one), blank lines left out."""
    lines = F.filter(F.transform(_lines(F.col("text")), lambda line: F.trim(line)), lambda line: line != "")
    marks = F.transform(lines, lambda line: _hash(line) * 2 + (F.char_length(line) >= LONG).cast("long"))
    return (docs.where(F.col("text").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), marks.alias("marks")))


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def _fingerprints(marked: DataFrame) -> DataFrame:
    """(name, doc_id, text_key, at, near): every selected position under the name of each window that selected it, with
    the marks of the line there and of REACH lines either way (NULL beyond the ends)."""
    rows = marked.select("doc_id", "text_key", "marks", F.posexplode("marks").alias("first", "mark"))
    lines = [F.get("marks", F.col("first") + k) for k in range(RUN)]  # NULL beyond the end
    long = [_is_long(x) for x in lines]
    windows = []
    for n in range(1, RUN + 1):
        named = lines[n - 1].isNotNull() & ~(_any(long[:n - 1]) & _any(long[1:n]))
        if n < RUN:
            named, selected = named & _any(long[:n]), F.coalesce(*[F.when(long[k], k) for k in range(n)])
        else:  # the rightmost of equal ones
            selected = -F.least(*[F.struct(x.alias("mark"), F.lit(-k).alias("back")) for k, x in enumerate(lines)])["back"]
        windows.append(F.when(named, F.struct(F.xxhash64(F.lit(n), *lines[:n]).alias("name"), (F.col("first") + selected).alias("at"))))
    near = F.struct(*[F.get("marks", F.col("found.at") + k).alias(f"line{k + REACH}") for k in range(-REACH, REACH + 1)])
    return (rows.select("doc_id", "text_key", "marks", F.explode(F.array(*windows)).alias("found")).where(F.col("found").isNotNull())
            .select("found.name", "doc_id", "text_key", "found.at", near.alias("near")))


def _matches(marked: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, near, others): places that meet the first ones of their names, and the lines around both."""
    found = _fingerprints(marked)
    at = F.struct("doc_id", "text_key", "at")
    first = (found.groupBy("name").agg(F.min(F.struct("doc_id", "text_key", "at", "near")).alias("origin"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    return (found.join(cut(first, "first"), "name").where(at > F.struct("origin.doc_id", "origin.text_key", "origin.at"))
            .select("doc_id", "text_key", "at", "near", F.col("origin.near").alias("others")))


def _runs(matches: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, n): every match grown both ways from its fingerprint, those that are long enough."""
    mark = [F.col(f"near.line{k}") for k in range(2 * REACH + 1)]
    same = [F.coalesce(x == F.col(f"others.line{k}"), F.lit(False)) for k, x in enumerate(mark)]
    part = [same[REACH]] * len(same)  # whether a line is of the run
    for k in range(1, REACH + 1):
        part[REACH - k] = part[REACH - k + 1] & same[REACH - k]
        part[REACH + k] = part[REACH + k - 1] & same[REACH + k]
    count = lambda flags: reduce(lambda a, b: a + b, [x.cast("int") for x in flags])
    return (matches.select("doc_id", "text_key", (F.col("at") - count(part[:REACH])).alias("first"), count(part).alias("n"),
                           _any([p & _is_long(x) for p, x in zip(part, mark)]).alias("long"))
            .where((F.col("n") >= RUN) | F.col("long")).drop("long"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being made once, however often ``use`` or a lambda in it looks into it."""
    return F.get(F.transform(F.array(value), use), 0)


def _without(lines: Column, gone: Column) -> Column:
    """The text of ``lines`` without those that ``gone`` counts, blank ones left out, in order."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    full = F.filter(every, lambda i: F.trim(F.get(lines, i)) != "")
    places = _with(full, lambda full: F.transform(gone, lambda k: F.get(full, k)))
    return F.array_join(F.transform(F.array_except(every, places), lambda i: F.get(lines, i)), "\n")


def deleted_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone): which lines of each text are deleted, counted without blank ones, in order."""
    marked = cut(_marked(docs).dropDuplicates(["doc_id", "text_key"]), "lines")
    most = 2 * REACH + 1
    return (_runs(_matches(marked)).groupBy("doc_id", "text_key")
            .agg(F.collect_set(F.col("first").cast("long") * most + F.col("n") - 1).alias("runs"))
            .select("doc_id", "text_key", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(
                F.floor(r / most).cast("int"), (F.floor(r / most) + F.pmod(r, F.lit(most))).cast("int")))))).alias("gone")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text) of every row, its repeated lines deleted."""
    gone = cut(deleted_lines(docs), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    joined = rows.alias("a").join(gone.alias("b"), same, "left").select("a.doc_id", "a.text", "b.gone")
    return joined.select(
        "doc_id", F.coalesce(F.size(F.when(F.col("text").isNotNull(), _lines(F.col("text")))), F.lit(0)).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_deleted"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_with(_lines(F.col("text")), lambda lines: _without(lines, F.col("gone"))))
        .alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split
), seq AS (
  SELECT doc_id, place, trim(line, ' ') AS line, length(trim(line, ' ')) >= {LONG} AS is_long,
    row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n
  FROM lines WHERE trim(line, ' ') <> ''
), windows AS (
  SELECT s.doc_id, s.n, size, string_agg(p.line, chr(10) ORDER BY p.n) AS content
  FROM seq s, range(1, {RUN} + 1) AS sizes(size) JOIN seq p ON p.doc_id = s.doc_id AND p.n >= s.n AND p.n < s.n + size
  GROUP BY s.doc_id, s.n, size HAVING count(*) = size AND (size = {RUN} OR bool_or(p.is_long))
), later AS (
  SELECT doc_id, n, size FROM windows QUALIFY row_number() OVER (PARTITION BY size, content ORDER BY doc_id, n) > 1
), gone AS (
  SELECT DISTINCT s.doc_id, s.place FROM seq s JOIN later l
  ON s.doc_id = l.doc_id AND s.n >= l.n AND s.n < l.n + l.size
), kept AS (
  SELECT l.doc_id, count(*) FILTER (g.place IS NOT NULL) AS n_deleted,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
)
SELECT s.doc_id, CAST(coalesce(len(s.parts), 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_deleted, 0) AS INTEGER) AS n_deleted,
  CASE WHEN s.text IS NOT NULL THEN k.text END AS text
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
