"""Near-duplicates by bottom-k sketches, exactly verified.

A text's set is that of its distinct word shingles.  One hash function orders all
shingles; a text retains the k smallest.  Texts with equal sets are one node.
Nodes whose sketches must overlap meet in inverted lists of retained values; the
sketch of a pair's union estimates their similarity; the full sets of what passes
are compared.  Links give components.

Which values are listed: a pair of similarity 0.8 shares at least half of each sketch.
So it is enough to list the half of a sketch, and one value, that is rarest over all
texts: two such halves have a value in common.  A passage that very many texts share
is common, hence not listed by texts that have enough else.

How lists are worked off: never by all pairs.  A list's members are compared with one
hub of it, the member whose values are retained most often, as the text that others
were copied from is; the lists of its copies have it in common.  That settles lists
whose members all became one component.  In the others, the members' full sets decide
which pairs are left: all shingles are put in one order, those that fewest unsettled
nodes have first.  If i shingles of one text and j of another come before the first
they have in common, none of these is shared, so the texts differ in i + j shingles at
least; a link at 80 % allows a ninth of both sizes.  So only a short prefix of each set
is listed, without shingles that a node has alone - what a copy changed by itself -, and
the join's condition compares positions, sizes and components.  This step is exact:
it finds every link that the hubs left, also those that the estimate didn't pass.

What can be lost: a pair whose sketches share less than half of their values.  At a
similarity of 0.8 and k = 64 the chance is 2e-08 at most (33 of 64 values in one text
only, each with a chance of 0.2), less for pairs more alike, and none with sets that
fit into the sketch; other paths through the component still join such a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinloom.llm import arrays
from joinloom.llm.components import components
from joinloom.llm.workspace import Workspace

#: Retained values of a sketch.
K = 64
#: How far under the threshold a hub's estimate may be; lower ones are left to the exact step.
MARGIN = 0.1
#: Rows up to which a table of two or three longs may be broadcast.
BROADCAST_ROWS = 100_000


def shingle_sets(batch: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, as signed 64-bit values."""
    buf, starts = arrays.joined(batch)
    begin, end = arrays.words(buf)
    h = arrays.span_hashes(buf, begin, end, fold=True)
    first = np.searchsorted(begin, starts)
    grams = arrays.ngrams(h, n)
    out = []
    for i in range(len(batch)):
        a, b = first[i], first[i + 1]
        own = grams[a : b - n + 1] if b - a >= n else arrays.whole(h[a:b]) if b > a else grams[:0]
        out.append(np.unique(own.view(np.int64)))
    return out


def _sets(texts: list[str], n: int):
    """``shingle_sets`` in chunks of bounded memory."""
    for part in arrays.chunks(np.array([len(x) for x in texts])):
        yield from shingle_sets(texts[part], n)


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a digest of the set), sketch."""

    def run(batches):
        for b in arrays.slices(batches):
            size, digests, values, ends = [], [], [], [0]
            for s in _sets(arrays.texts(b.column("text")), n):
                size.append(len(s))
                digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                values.append(s[:k])
                ends.append(ends[-1] + len(values[-1]))
            if size:
                d = np.array(digests)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def verified(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs (hub, m, text_hub, text_m) -> (hub, m, linked), by their full sets."""

    def run(batches):
        for b in arrays.slices(batches):
            left, right = arrays.texts(b.column("text_hub")), arrays.texts(b.column("text_m"))
            linked = []
            for s, t in zip(_sets(left, n), _sets(right, n), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("m"), pa.array(linked, pa.bool_())], ["hub", "m", "linked"])

    return pairs.select("hub", "m", "text_hub", "text_m").mapInArrow(run, "hub long, m long, linked boolean")


def _listed(nodes: DataFrame) -> DataFrame:
    """(v, node, weight): of each node's sketch the rarest values, half of them and
    one.  weight: how often its values are retained in all, large for a node amid many
    similar ones."""
    held = nodes.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = held.groupBy("v").count().filter("count > 1")
    ranked = held.join(often, "v").groupBy("node", "s").agg(F.sort_array(F.collect_list(F.struct("count", "v"))).alias("shared"), F.sum("count").alias("weight"))
    length = F.expr("greatest(0, floor(s / 2) + 1 - (s - size(shared)))").cast("int")
    return ranked.select("node", "weight", F.explode(F.slice("shared", F.lit(1), length)).alias("x")).select("x.v", "node", "weight")


def _merged(comp: DataFrame | None, links: DataFrame, work: Workspace) -> DataFrame:
    """Components after more links (a, b).  Only components are linked anew, not nodes."""
    if comp is None:
        return components(links, work)
    old = comp.select(F.col("id").alias("of"), F.col("comp").alias("c"))
    for end in ("a", "b"):
        links = links.join(old, F.col(end) == F.col("of"), "left").withColumn(end, F.coalesce("c", end)).drop("of", "c")
    new = components(links, work)
    moved = old.join(new, F.col("c") == F.col("id"), "left").select(F.col("of").alias("id"), F.coalesce("comp", "c").alias("comp"))
    return work.stage(moved.unionByName(new), "components")


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """(hub, m): each list's members with its hub; each pair once."""
    heads = lists.groupBy("v").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("h"), F.count("*").alias("n")).filter("n > 1")
    heads = heads.select("v", (-F.col("h.node")).alias("hub"))
    pairs = lists.join(heads, "v").filter("node <> hub").select("hub", F.col("node").alias("m"))
    pairs = pairs.groupBy(F.least("hub", "m").alias("low"), F.greatest("hub", "m").alias("high")).agg(F.max("hub").alias("hub"))
    return pairs.select("hub", (F.col("low") + F.col("high") - F.col("hub")).alias("m"))


def _unsettled(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(node, comp) of nodes in lists with several components."""
    if comp is None:
        member = lists.select("v", "node", F.col("node").alias("comp"))
    else:
        member = lists.select("v", "node").join(comp, F.col("node") == F.col("id"), "left").select("v", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = member.groupBy("v").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("v")
    return member.join(open_, "v", "left_semi").select("node", "comp").distinct()


def _prefixes(unsettled: DataFrame, text: DataFrame, n: int, percent: int) -> DataFrame:
    """(h, node, comp, n, i): the shingles of each set, in the one order of all, among
    which a link's first common one must be; i: how many of the set come before."""

    def run(batches):
        for b in arrays.slices(batches):
            sets = list(_sets(arrays.texts(b.column("text")), n))
            size = [len(x) for x in sets]
            node, comp = (np.repeat(b.column(c).to_numpy(), size) for c in ("node", "comp"))
            at = np.repeat(size, size)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, comp, at, np.concatenate([*sets, np.empty(0, np.int64)]))], ["node", "comp", "n", "h"])

    each = text.join(unsettled, "node").select("node", "comp", "text").mapInArrow(run, "node long, comp long, n long, h long")
    often = each.groupBy("h").count().filter("count > 1")
    sets = each.join(often, "h").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("shared"))
    alone = F.col("n") - F.size("shared")  # these come first
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    sets = sets.select("node", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))).alias("at", "x"))
    return sets.select("x.h", "node", "comp", "n", (F.col("alone") + F.col("at")).alias("i"))


def _left_pairs(prefixes: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(hub, m) of different components that may still be linked, each once.

    A pair is linked if it differs in d shingles with (100 + percent) * d <=
    (100 - percent) * (sum of the sizes).  q is a text's own part of that at its i; only
    nodes whose q some other's can make up for stay in a shingle's list, and its
    commonest component is not compared with itself."""
    q = F.col("i") * (100 + percent) - F.col("n") * (100 - percent)
    rows = work.stage(prefixes.withColumn("q", q), "prefixes")
    parts = rows.groupBy("h", "comp").agg(F.count("*").alias("c"), F.min("q").alias("q"))
    of = parts.groupBy("h").agg(F.min("q").alias("least"), F.max(F.struct("c", (-F.col("comp")).alias("comp"))).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    rows = rows.join(of.select("h", "least", (-F.col("most.comp")).alias("big")), "h").filter("q + least <= 0")
    rows = work.stage(rows.select("h", "node", "comp", "n", "i", "q", (F.col("comp") == F.col("big")).alias("big")), "positions")
    a = rows.filter("NOT big").select(*[F.col(c).alias(f"a_{c}") for c in ("h", "node", "comp", "n", "i", "q")])
    longer = F.col("a_n") - F.col("n")
    differ = 2 * F.greatest(F.col("a_i"), F.col("i") + longer) - longer
    fits = (F.col("a_q") + F.col("q") <= 0) & ((100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("n")))
    fits &= 100 * F.least("a_n", "n") >= percent * F.greatest("a_n", "n")
    pairs = a.join(rows, (F.col("a_h") == F.col("h")) & (F.col("a_comp") != F.col("comp")) & (F.col("big") | (F.col("a_node") < F.col("node"))) & fits)
    return pairs.select(F.greatest("a_node", "node").alias("hub"), F.least("a_node", "node").alias("m")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A text
    of fewer than ``shingle`` words is one shingle; without words it has none and
    is linked with nothing (component: itself).  A null text is empty.  Rows with
    one doc_id are taken for the same text; each is returned.  A row whose doc_id
    is null is linked with nothing: component null, kept true.  Texts are linked if
    100 * shared >= percent * union; component_id is the smallest doc_id that links
    reach.  Columns other than doc_id and text are not read.  Empty in, empty out.
    Texts are taken whole; a very long one is one row of a task, its set held in memory.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    s = work.stage(sketches(docs, shingle, k), "sketches")
    named = s.filter("doc_id IS NOT NULL AND n_shingles > 0")
    groups = work.stage(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "groups")
    nodes = named.join(groups.select("d1", "d2", F.col("node").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
    lists = work.stage(_listed(nodes), "lists")
    of = lists.select("node").distinct()
    sketch = work.stage(nodes.join(of, "node", "left_semi").dropDuplicates(["node", "n_shingles"]), "listed-sketches")
    text = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(of, "node", "left_semi")
    text = work.stage(text.dropDuplicates(["node"]), "listed-texts")

    pairs = work.stage(_estimated(_hub_pairs(lists), sketch, k, percent), "estimated")
    best = F.row_number().over(_by("m", F.desc("estimate"), "hub"))
    tries = work.stage(pairs.withColumn("r", best).filter("r = 1").select("hub", "m"), "tries")
    comp = None
    if not tries.isEmpty():
        comp = _merged(None, _links(tries, text, shingle, percent, work), work)
    unsettled = work.stage(_unsettled(lists, comp), "unsettled")
    tries = work.stage(_left_pairs(_prefixes(unsettled, text, shingle, percent), percent, work), "left")
    if not tries.isEmpty():
        comp = _merged(comp, _links(tries, text, shingle, percent, work), work)
    work.release(lists, sketch, text)

    member = named.select("doc_id", "d1", "d2").join(groups, ["d1", "d2"])
    if comp is not None:
        member = member.join(comp, F.col("node") == F.col("id"), "left").select("doc_id", "d1", "d2", F.coalesce("comp", "node").alias("component_id"))
    else:
        member = member.withColumnRenamed("node", "component_id")
    member = member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = s.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return work.result(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that are kept: one of each component."""
    gone = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def _by(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def _estimated(pairs: DataFrame, sketch: DataFrame, k: int, percent: int) -> DataFrame:
    """(hub, m, estimate) of the pairs whose sizes and union sketch speak for a link."""
    short = F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))  # in the same order; enough for an estimate
    a = sketch.select(F.col("node").alias("hub"), short.alias("sa"), F.col("n_shingles").alias("na"))
    b = sketch.select(F.col("node").alias("m"), short.alias("sb"), F.col("n_shingles").alias("nb"))
    x = pairs.join(a, "hub").join(b, "m").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    x = x.select("hub", "m", union.alias("u"), F.array_intersect("sa", "sb").alias("i"))
    x = x.select("hub", "m", (F.size(F.array_intersect("i", "u")) / F.size("u")).alias("estimate"))
    return x.filter(F.col("estimate") >= percent / 100 - MARGIN)


def _links(tries: DataFrame, text: DataFrame, n: int, percent: int, work: Workspace) -> DataFrame:
    """(a, b) of the pairs that their full sets link.  Few pairs fetch their texts by
    broadcast (two longs a row, at most BROADCAST_ROWS rows); many by shuffle."""
    if tries.count() <= BROADCAST_ROWS:
        tries = F.broadcast(tries)
    x = text.select(F.col("node").alias("m"), F.col("text").alias("text_m")).join(tries, "m")
    x = x.join(text.select(F.col("node").alias("hub"), F.col("text").alias("text_hub")), "hub")
    return work.stage(verified(x, n, percent), "verified").filter("linked").select(F.col("hub").alias("a"), F.col("m").alias("b"))
