"""Line-run deduplication by a suffix array over line IDs, in SQL functions only.

A text is a sequence of line IDs (128 bits of hash of each line that isn't blank).  The
suffix array of all texts is made by distributed prefix doubling: a level's keys - line
IDs, then pairs of ranks 1, 2, 4, ... lines apart - are counted, sorted over all machines,
and a key's rank is the number of suffixes before it, which is where its interval begins
in the array.  The suffixes in an interval of level j share their first 2^j lines.  A
suffix alone in its interval shares no more with any other, so it has no rank from there on
and is not sorted again; of lines, only stretches of ``min_words`` words or more in which
each line occurs elsewhere take part.

Longest common prefixes: two suffixes share m lines if they have equal ranks for the first
2^j <= m of them and, m - 2^j lines on, for the last 2^j.  So the suffixes that share the
fewest lines that have ``min_words`` words, forwards from a line or backwards from it, are
one interval, named by two ranks; a maximal repeated run is the union of such intervals'
runs, and doubling needs to go no deeper than ``min_words`` lines.  The first suffix of an
interval (by doc_id and line) stays; the lines of the others are later copies and go.

The unit is the whole line: a repeated passage that begins or ends inside lines counts only
from its first whole common line to its last, and one inside a single line isn't found.

Keys are aggregated with partial sums and ranks joined back: a line or run that a third of
all texts hold is a skewed join key, never a group in one task.  Sorting is of distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinloom.llm.workspace import Workspace

MIN_WORDS = 50


def _words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1)


def _lifted(cum: Column, size: Column, i: Column, steps: list[int], words: int, back: bool) -> Column:
    """Fewest lines from i on (or back from it) with ``words`` words, 0 if there aren't."""

    def total(n: Column) -> Column:
        return F.get(cum, i + 1) - F.get(cum, i + 1 - n) if back else F.get(cum, i + n) - F.get(cum, i)

    room = i + 1 if back else size - i
    under = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda n, step: F.when((n + step <= room) & (total(n + step) < words), n + step).otherwise(n),
    )
    return F.when(under + 1 <= room, under + 1).otherwise(0)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, r (its number among the text's lines that aren't blank), at (among all), a
    and b (its ID), w (words)."""
    x = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    x = x.select("doc_id", F.posexplode(F.filter(F.transform("lines", lambda t, i: F.struct(F.trim(t).alias("t"), i.alias("at"))), lambda t: t["t"] != "")).alias("r", "l"))
    return x.select("doc_id", "r", "l.at", F.xxhash64("l.t").alias("a"), F.xxhash64(F.lit("line"), "l.t").alias("b"), _words(F.col("l.t")).alias("w"))


def _ranked(rows: DataFrame, key: list[str], work: Workspace) -> DataFrame:
    """The keys that several rows have, with rank: how many rows have a smaller one of them."""
    shared = rows.groupBy(*key).count().filter("count > 1")
    shared = work.stage(shared.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "sorted")
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shared.groupBy("part").agg(F.sum("count").alias("n")).select("part", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("first") + F.coalesce(F.sum("count").over(within), F.lit(0))
    return shared.join(F.broadcast(parts), "part").select(*key, rank.alias("rank"))  # a row for each partition


def _stretches(lines: DataFrame, words: int, work: Workspace) -> DataFrame:
    """doc_id, s, r, at, w, n0: the lines that occur elsewhere and stand in a row of such
    lines, s, with enough words.  n0: the rank of the line."""
    ids = _ranked(lines, ["a", "b"], work)
    own = lines.join(ids.withColumnRenamed("rank", "n0"), ["a", "b"])
    # A set, as rows of one doc_id may be repeated.
    x = own.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("r", "at", "w", "n0"))).alias("lines"))
    x = x.select("doc_id", F.posexplode("lines").alias("i", "l")).select("doc_id", (F.col("l.r") - F.col("i")).alias("s"), "l.*")
    return x.withColumn("all", F.sum("w").over(Window.partitionBy("doc_id", "s"))).filter(F.col("all") >= words).drop("all")


def _runs(docs: DataFrame, words: int, work: Workspace) -> DataFrame:
    """doc_id, x, y, m, i, last: the deciding runs of each text, m lines from line i to
    ``last``; x and y: the ranks that name it.  Runs that no suffix shares are left out."""
    lines = work.stage(_lines(docs), "lines")
    rows = work.stage(_stretches(lines, words, work), "stretches")
    work.release(lines)
    levels = max(0, words.bit_length() - 1)  # a run has at least as many words as lines
    for j in range(levels):
        ahead = Window.partitionBy("doc_id", "s").orderBy("r").rangeBetween(1 << j, 1 << j)
        rows = work.stage(rows.withColumn("then", F.max(f"n{j}").over(ahead)), f"pairs-{j}")
        pairs = _ranked(rows.filter(f"n{j} IS NOT NULL AND then IS NOT NULL"), [f"n{j}", "then"], work)
        rows = rows.join(pairs.withColumnRenamed("rank", f"n{j + 1}"), [f"n{j}", "then"], "left").drop("then")
    names = [f"n{j}" for j in range(levels + 1)]
    x = rows.groupBy("doc_id", "s").agg(F.array_sort(F.collect_list(F.struct("r", "at", "w", *names))).alias("l"))
    x = x.select("doc_id", F.size("l").alias("size"), *[F.col("l")[c].alias(c) for c in ("at", "w", *names)])
    x = _with_sums(x)
    steps = [1 << j for j in reversed(range(levels + 1))]
    spans = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda i: F.array(
            F.struct(i.alias("i"), _lifted(F.col("cum"), F.col("size"), i, steps, words, False).alias("m")),
            F.struct(i.alias("i"), _lifted(F.col("cum"), F.col("size"), i, steps, words, True).alias("m")),
        ),
    )
    # A run backwards from line i begins at i + 1 - m.
    both = F.transform(F.col("spans"), lambda s: F.array(s[0], F.struct((s[1]["i"] + 1 - s[1]["m"]).alias("i"), s[1]["m"].alias("m"))))
    x = x.withColumn("spans", spans)
    x = x.withColumn("spans", F.array_distinct(F.filter(F.flatten(both), lambda s: s["m"] > 0)))

    def name(s: Column, on: Column | int) -> Column:
        out = F.lit(None).cast("long")
        for j, column in enumerate(names):
            out = F.when((s["m"] >= (1 << j)) & (s["m"] < (2 << j)), F.get(F.col(column), s["i"] + on * (s["m"] - (1 << j)))).otherwise(out)
        return out

    run = F.transform("spans", lambda s: F.struct(name(s, 0).alias("x"), name(s, 1).alias("y"), s["m"].alias("m"), F.get(F.col("at"), s["i"]).alias("i"), F.get(F.col("at"), s["i"] + s["m"] - 1).alias("last")))
    return x.select("doc_id", F.explode(F.filter(run, lambda s: s["x"].isNotNull() & s["y"].isNotNull())).alias("s")).select("doc_id", "s.*")


def _with_sums(x: DataFrame) -> DataFrame:
    """cum: 0, w[0], w[0] + w[1], ...  Sums of slices from the start, or a fold that
    appends, would be quadratic in a text's lines; blocks of 64 lines bound both."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, v: s + v)

    size, w = F.col("size"), F.col("w")
    blocks = F.sequence(F.lit(0), F.floor(size / 64).cast("int"))
    x = x.withColumn("heads", F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(w, b * 64 + 1, F.lit(64)))))))
    block = lambda i: F.floor(i / 64).cast("int")
    at = F.sequence(F.lit(0), size)
    return x.withColumn("cum", F.transform(at, lambda i: F.get(F.col("heads"), block(i)) + total(F.slice(w, block(i) * 64 + 1, (i % 64).cast("int"))))).drop("heads")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with n_lines, n_removed and
    new_text: the text without lines that lie in a later copy of a run of lines of
    ``min_words`` words or more that repeats, within a text or across texts.

    Lines are compared without outer blanks (a word ends at a blank); blank lines take
    no part and stay.  The earliest copy, by doc_id and line, stays.  A null text has
    no lines: new_text null, counts 0.  Rows with a null doc_id are left as they are;
    rows with one doc_id are taken for the same text and all stay.  The three names
    replace columns of those names.  Empty in, empty out.  A text is one row of a task,
    however long.
    """
    key, work = F.col("doc_id").cast("long"), Workspace(docs.sparkSession, "line-dedup")
    runs = work.stage(_runs(docs.select(key.alias("doc_id"), "text"), min_words, work), "runs")
    first = runs.groupBy("x", "y", "m").agg(F.min(F.struct("doc_id", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = runs.join(first.drop("n"), ["x", "y", "m"]).filter(F.struct("doc_id", "i") != F.col("first")).select("doc_id", "i", "last")
    # Each line once, however many runs it is in.
    before = Window.partitionBy("doc_id").orderBy("i", "last").rowsBetween(Window.unboundedPreceding, -1)
    late = late.withColumn("i", F.greatest("i", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))).filter("i <= last")
    gone = late.groupBy(F.col("doc_id").alias("gone_id")).agg(F.flatten(F.collect_list(F.sequence("i", "last"))).alias("gone"))
    gone = work.result(gone)
    x = docs.drop("n_lines", "n_removed", "new_text").join(gone.hint("merge"), key == F.col("gone_id"), "left").drop("gone_id")
    x = x.withColumn("__lines", F.split("text", "\n", -1))  # after the join: texts are moved once
    # Blank lines between the lines of a run stay.
    removed = F.filter(F.col("gone"), lambda i: F.trim(F.get(F.col("__lines"), i)) != "")
    x = x.withColumn("gone", F.coalesce(removed, F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone")), lambda i: F.get(F.col("__lines"), i))
    new = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return x.withColumns({"n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lines")), F.lit(0)), "n_removed": F.size("gone"), "new_text": new}).drop("__lines", "gone")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the new texts, and n_chars counted anew; texts that lost all they
    had but blank lines are left out.  Columns and their order stay."""
    x = line_dedup(docs, min_words).filter((F.col("n_removed") == 0) | (F.trim(F.replace("new_text", F.lit("\n"))) != ""))
    new = {"text": F.col("new_text")} | ({"n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return x.withColumns(new).select(*docs.columns)


#: For the query: its rows from the table ``documents``.
SQL = f"""
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(range(len(lines))) AS pos, trim(unnest(lines), ' ') AS t FROM doc),
seq AS (SELECT doc_id, pos, t, length(t) - length(replace(t, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM line WHERE t <> ''),
cum AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY r) AS c FROM seq),
ahead AS (SELECT a.doc_id, a.r AS lo, min(b.r) AS hi FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + {MIN_WORDS} AND b.c - a.c + a.w >= {MIN_WORDS} GROUP BY 1, 2),
back AS (SELECT a.doc_id, max(b.r) AS lo, a.r AS hi FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r - {MIN_WORDS} AND a.r AND a.c - b.c + b.w >= {MIN_WORDS} GROUP BY 1, 3),
span AS (SELECT * FROM ahead UNION SELECT * FROM back),
run AS (SELECT s.doc_id, s.lo, s.hi, list(c.t ORDER BY c.r) AS body FROM span s JOIN cum c ON c.doc_id = s.doc_id AND c.r BETWEEN s.lo AND s.hi GROUP BY 1, 2, 3),
first AS (SELECT body, min({{'d': doc_id, 'r': lo}}) AS f FROM run GROUP BY body HAVING count(*) > 1),
late AS (SELECT DISTINCT run.doc_id, unnest(range(lo, hi + 1)) AS r FROM run JOIN first USING (body) WHERE {{'d': run.doc_id, 'r': lo}} <> f),
gone AS (SELECT cum.doc_id, cum.pos FROM late JOIN cum USING (doc_id, r)),
every AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS t FROM doc),
kept AS (SELECT every.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, string_agg(every.t, chr(10) ORDER BY every.pos) FILTER (WHERE gone.pos IS NULL) AS t
         FROM every LEFT JOIN gone ON every.doc_id = gone.doc_id AND every.pos = gone.pos GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS new_text
FROM documents d LEFT JOIN kept USING (doc_id)
"""
