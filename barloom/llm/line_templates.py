"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its first ``DEPTH`` tokens, digits masked, to a leaf. Within a
leaf the line is cut into ``PARTS`` runs of tokens, and the template keeps, for each run, the value that most of the
leaf's lines have; runs that differ are the variable fields. A line belongs to the template if the runs that equal it
hold at least ``SIMILAR`` of its tokens. A template that lines of ``MIN_DOCS`` or more documents belong to recurs: its
lines are dropped from every document but the first (smallest id), so that no text is lost altogether.

All of it is DataFrame work: leaves are counted on hashes, only lines of recurring leaves are looked at again, and
counts are combined before each shuffle, so a line in a third of all documents costs no more than any other.

That is ``dedup_lines``. The query and the pipeline's stage (``cut_lines``) keep every template of a leaf: the tokens beyond
the leaf's are cut into ``FINE`` runs, and each choice of at most two runs to leave open, holding no more than
``1 - ALIKE`` of those tokens, is a template if enough documents agree in all the other runs.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import query, store, table, unused

DEPTH = 3
PARTS = 8
SIMILAR = 0.6
MIN_DOCS = 3
FINE = 10
ALIKE = 0.8
#: Runs of a line that are compared whole before choices of open runs are tried.
BANDS = ((0, 3), (3, 6), (6, 10))
#: Lines of more tokens recur from two documents on if they are the same, digits masked.
LONG = 50


def masked(text: Column) -> Column:
    """Digits as one zero for each run of them, blanks, tabs and carriage returns as single blanks."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), "[\t\r][ \t\r]*| [ \t\r]+", " ")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, n, leaf) of every line that is not blank; ``n`` tokens stand between single blanks."""
    lines = docs.select("doc_id", F.posexplode(F.split(masked(F.col("text")), "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.trim("line").alias("line")).where(F.col("line") != "")
    sized = lines.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return sized.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", DEPTH)))


def _bounds(j: int) -> tuple[Column, Column]:
    """First token (from 1) and number of tokens of run ``j``."""
    low, high = F.floor(F.col("n") * j / PARTS).cast("int"), F.floor(F.col("n") * (j + 1) / PARTS).cast("int")
    return low + 1, high - low


def dropped_lines(docs: DataFrame, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line_no) of the lines that go. ``docs`` has doc_id and text."""
    lines = lines_of(docs)
    leaves = lines.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("doc_id").alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    runs = F.array(*(F.xxhash64(F.concat_ws(" ", F.slice("tokens", *_bounds(j)))) for j in range(PARTS)))
    tokens = lines.withColumn("tokens", F.split("line", " "))
    found = store(tokens.select("leaf", "doc_id", "line_no", "n", runs.alias("runs")).join(store(leaves), "leaf"))

    counted = found.select("leaf", "doc_id", "line_no", F.posexplode("runs").alias("j", "run")).groupBy("leaf", "j", "run").agg(F.count("*").alias("lines"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    ranked = F.struct(-F.col("lines"), "first.doc_id", "first.line_no", "run")
    kept = counted.groupBy("leaf", "j").agg(F.min(ranked).alias("best")).select("leaf", "j", F.col("best.run").alias("run"))
    template = kept.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("j", "run"))).alias("template"))

    equal = sum(F.when(F.col("runs")[j] == F.col("template")[j]["run"], _bounds(j)[1]).otherwise(0) for j in range(PARTS))
    members = found.join(template, "leaf").where(equal >= F.col("n") * similar).select("leaf", "doc_id", "line_no")
    recurring = members.groupBy("leaf", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).where(F.col("docs") >= min_docs)
    return members.join(recurring, "leaf").where(F.col("doc_id") != F.col("first_doc")).select("doc_id", "line_no")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines that go by the rule of ``cut_lines``. ``docs`` has doc_id, text_hash, text."""
    named = docs.where(F.col("doc_id").isNotNull())
    hashed = lines_of(named.select(F.struct("doc_id", "text_hash").alias("doc_id"), "text")).withColumn("hash", F.xxhash64("line"))
    beyond = F.col("n") - DEPTH  # tokens; fewer than five must all agree
    edge = lambda j: F.floor(beyond * j / FINE).cast("int")
    runs = F.array(*(F.xxhash64(F.lit(j), F.slice("tokens", edge(j) + DEPTH + 1, edge(j + 1) - edge(j))) for j in range(FINE)))
    runs = F.when(beyond * (1 - ALIKE) > 1 - 1e-9, runs)
    lines = store(hashed.withColumn("tokens", F.split("line", " ")).select("doc_id.doc_id", "doc_id.text_hash", "line_no", "n", "leaf", "hash", runs.alias("runs")))
    whole = store(lines.select("leaf", "hash", "n", "doc_id").distinct().groupBy("leaf", "hash", "n").agg(F.count("*").alias("docs"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    exact = whole.where(F.col("docs") >= F.when(F.col("n") > LONG, 2).otherwise(MIN_DOCS)).select("hash", F.col("low").alias("first"))

    # two open runs touch two bands at most, so lines of one template agree in a whole band; the others need not be tried
    bands = F.explode(F.array(*(F.xxhash64("leaf", F.lit(k), F.slice("runs", a + 1, b - a)) for k, (a, b) in enumerate(BANDS))))
    banded = lines.where(F.col("runs").isNotNull()).select("hash", "doc_id", bands.alias("band"))
    band = Window.partitionBy("band")
    ends = banded.select("hash", *(f(k).over(band).alias(f"{k}_{i}") for k in ("hash", "doc_id") for i, f in enumerate((F.min, F.max))))
    # grows with the input, so it is joined by a shuffle at every size
    near = store(ends.where("hash_0 <> hash_1 and doc_id_0 <> doc_id_1").select("hash").distinct()).hint("merge")
    cut = lines.select("hash", "n", "runs").join(near, "hash").dropDuplicates(["hash"]).select("hash", "runs", F.array(*(edge(j + 1) - edge(j) for j in range(FINE))).alias("sizes"))

    left_open = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations_with_replacement(range(FINE), 2))))
    tried = store(cut.join(whole.join(near, "hash"), "hash")).withColumn("w", left_open)
    size, run = (lambda k: F.col("sizes")[F.col(f"w.{k}")]), (lambda k: F.col("runs")[F.col(f"w.{k}")])
    one = F.col("w.a") == F.col("w.b")
    tried = tried.where((size("a") > 0) & (size("b") > 0) & (F.when(one, size("a")).otherwise(size("a") + size("b")) <= beyond * (1 - ALIKE) + 1e-9))
    all_runs = F.aggregate("runs", F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y))
    rest = F.when(one, all_runs.bitwiseXOR(run("a"))).otherwise(all_runs.bitwiseXOR(run("a")).bitwiseXOR(run("b")))
    patterns = store(tried.select(F.xxhash64("leaf", "w.a", "w.b", rest).alias("pattern"), "hash", "docs", "low", "high"))
    several = patterns.groupBy("pattern").agg(F.max("docs").alias("docs"), F.min("low").alias("first"), F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").drop("a", "b")
    # a line of fewer than MIN_DOCS documents lies in no other than its lowest and its highest
    within = patterns.select("pattern", F.explode(F.array("low", "high")).alias("doc")).distinct().groupBy("pattern").agg(F.count("*").alias("met"))
    templates = several.join(within, "pattern").where(F.greatest("docs", "met") >= MIN_DOCS).select("pattern", "first")
    general = patterns.select("pattern", "hash").join(templates, "pattern").select("hash", "first")

    firsts = exact.union(general).groupBy("hash").agg(F.min("first").alias("first"))
    return lines.join(firsts, "hash").where(F.col("doc_id") > F.col("first")).select("doc_id", "text_hash", "line_no")


def cut_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``, every template of a leaf counting; every row stays.

    A line goes if a smaller doc_id has a line of one of its templates, and lines of that template lie in ``MIN_DOCS``
    documents or more; two are enough for the same line of more than ``LONG`` tokens. Lines of a template agree in all tokens if they have fewer than eight, else in the first
    ``DEPTH`` and in ``ALIKE`` or more of the others; what a line that goes has in its open runs is lost with it. Rows
    are known by id and text. Null texts, blank lines and rows with a null id stay as in ``dedup_lines``.
    """
    key, name = unused("text_hash", docs), unused("gone", docs)
    dropped = recurring_lines(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))
    gone = dropped.groupBy("doc_id", F.col("text_hash").alias(key)).agg(F.collect_set("line_no").alias(name))
    out = docs.withColumn(key, F.xxhash64("text")).join(gone.hint("shuffle_hash"), ["doc_id", key], "left")
    return out.withColumn("text", _rest(F.col(name))).select(docs.columns)


def _cleaned(docs: DataFrame, dropped: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with a last column of the line numbers that go (null if none goes), and that column."""
    key, name = unused("gone_id", docs), unused("gone", docs)
    gone = dropped.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(name))
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(key), "left").drop(key), F.col(name)


def _rest(gone: Column) -> Column:
    """The text without the lines that go."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, similar: float = SIMILAR, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``; every row stays, with all its columns.

    Null texts stay null and blank lines stay where they are. A line of a row with a null id never goes. Rows of the same id count
    as one document. Of equally frequent runs the one of the smallest (doc_id, line) enters the template. A document
    that loses all its lines is left with an empty text. Empty tables give no rows.
    """
    dropped = dropped_lines(docs.select(F.col("doc_id"), F.col("text")), similar, min_docs)
    out, gone = _cleaned(docs, dropped)
    return out.withColumn("text", _rest(gone)).select(docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row by the rule of ``cut_lines``; lines that go are not in ``text``.

    A null text has no lines and stays null; an empty one has one blank line. Blank lines and lines of a row with a null
    id never go. Rows of one id are told apart by their texts; equal rows lose the same lines. A document that loses all
    its lines has an empty text. Texts of any length are cut whole; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    gone = recurring_lines(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    out = docs.withColumn("text_hash", F.xxhash64("text")).join(gone.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return out.select("doc_id", lines.cast("bigint").alias("n_lines"), dropped.cast("bigint").alias("n_dropped"), _rest(F.col("gone")).alias("text"))


_RUN = "array_to_string(t[4 + CAST(floor((n - 3) * {j} / 10.0) AS INT):3 + CAST(floor((n - 3) * ({j} + 1) / 10.0) AS INT)], ' ')"
_SIZE = "CAST(floor((n - 3) * ({j} + 1) / 10.0) - floor((n - 3) * {j} / 10.0) AS INT)"
SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d
), t AS (
  SELECT doc_id, text, i, trim(regexp_replace(regexp_replace(translate(line, '123456789' || chr(9) || chr(13), '000000000  '), '0+', '0', 'g'), ' +', ' ', 'g'), ' ') AS line FROM l
), k AS (
  SELECT doc_id, text, i, line, string_split(line, ' ') AS t, len(string_split(line, ' ')) AS n, len(string_split(line, ' ')) || ':' || array_to_string(string_split(line, ' ')[1:3], ' ') AS leaf FROM t WHERE line <> ''
), w AS (
  SELECT leaf, line, n, any_value(t) AS t, count(DISTINCT doc_id) AS docs, min(doc_id) AS low, max(doc_id) AS high FROM k GROUP BY leaf, line, n
), e AS (
  SELECT line, low AS first FROM w WHERE docs >= CASE WHEN n > 50 THEN 2 ELSE 3 END
), c AS (
  SELECT leaf FROM w WHERE (n - 3) * 0.2 > 1 - 1e-9 GROUP BY leaf HAVING min(line) <> max(line) AND min(low) <> max(high)
), r AS (
  SELECT leaf, line, docs, low, high, n, [{", ".join(_RUN.format(j=j) for j in range(FINE))}] AS r, [{", ".join(_SIZE.format(j=j) for j in range(FINE))}] AS s FROM w JOIN c USING (leaf)
), o AS (
  SELECT r.*, a, b FROM r, range({FINE}) AS x(a), range({FINE}) AS y(b)
  WHERE a <= b AND s[a + 1] > 0 AND s[b + 1] > 0 AND CASE WHEN a = b THEN s[a + 1] ELSE s[a + 1] + s[b + 1] END <= (n - 3) * 0.2 + 1e-9
), p AS (
  SELECT struct_pack(leaf := leaf, a := a, b := b, rest := list_transform(r, lambda x, i: CASE WHEN i = a + 1 OR i = b + 1 THEN '' ELSE x END)) AS p, line, docs, low, high FROM o
), m AS (
  SELECT p, max(docs) AS docs, min(low) AS first FROM p GROUP BY p HAVING min(line) <> max(line)
), v AS (
  SELECT p, count(DISTINCT x) AS met FROM (SELECT p, unnest([low, high]) AS x FROM p) GROUP BY p
), g AS (
  SELECT p.line, m.first FROM p JOIN m ON m.p = p.p JOIN v ON v.p = p.p WHERE greatest(m.docs, v.met) >= 3
), f AS (
  SELECT line, min(first) AS first FROM (SELECT * FROM e UNION ALL SELECT * FROM g) GROUP BY line
), x AS (
  SELECT k.doc_id, k.text, list(k.i) AS gone FROM k JOIN f ON f.line = k.line WHERE k.doc_id > f.first GROUP BY k.doc_id, k.text
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(x.gone), 0) AS BIGINT) AS n_dropped,
  CASE WHEN x.gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda v, i: NOT list_contains(x.gone, i - 1)), chr(10)), '') END AS text
FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id AND x.text = d.text
"""


@query("op1_line_dedup", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
