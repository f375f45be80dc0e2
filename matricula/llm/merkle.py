"""Merkle manifest of a table: one tree of digests for each language, and one over their roots.

No document is sorted. The ids of each language are a bitmap of words of 64 bits, built by a partial
aggregate and merged over all tasks; words without an id are not stored. Directories of counts (of a
word, and of 2^11, 2^16, 2^32 and 2^48 ids) are running sums, each over the few entries within the next
wider one; so a document's place is the sum of its directories' counts and of the bits below its own,
however ids are spread. By its place each leaf goes to a slot of an array keyed by (language, run of
8^3 leaves); such an array reduces three levels of the tree where it lies, and arrays of their nodes
the next three. On the way back each array hands the siblings on the way to the root down to its slots.

Everything is built-in expressions. Each shuffle deals by place, so no key is larger than a run.

Defined results: every row is a leaf. Rows without a doc_id come first in their language, those that
repeat a doc_id next to each other; both are ordered by the first half of their leaves (rows with the
same leaf in any order, which changes no digest). Rows without a doc_id are never tampered with. An
empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

#: Children of a node, and levels that an array of slots reduces.
CHILDREN, LEVELS = 8, 3
RUN = CHILDREN**LEVELS
#: Rows of one leaf are numbered in so many parts.
PARTS = 1024
#: Trees up to which their depths are broadcast; beyond, they are joined by shuffle.
BROADCAST_TREES = 10_000
#: The word number of rows without an id, below all others.
NO_ID = -(1 << 60)
#: How far a word's number is shifted for each wider directory.
_WIDER = (42, 26, 10, 5)


def H(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of strings, put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """row, doc_id, tree (a language; '' for none), leaf, and told: the leaf of the tampered row."""
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)) & (text != F.col("text"))
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = H(*head, field(F.col("text")))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        leaf.alias("leaf"),
        F.when(tampered, H(*head, field(text))).alias("told"),
    )


def places(counted: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """group, digits and `before`: how many rows of the group come before those of the digits.

    `counted`: n rows for each group and digits (any parts of it). Each digit's running sum is over
    the entries that share all digits before it.
    """
    out = None
    for k in range(1, len(digits) + 1):
        keys = group + digits[:k]
        entries = counted.groupBy(*keys).agg(F.sum("n").alias("n"))
        order = W.partitionBy(*group, *digits[: k - 1]).orderBy(digits[k - 1])
        own = entries.select(*keys, (F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("own"))
        out = own.withColumnRenamed("own", "before") if out is None else own.join(out, keys[:-1]).select(*keys, (F.col("before") + F.col("own")).alias("before"))
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (row, doc_id, tree, leaf, ...) with r, their place in their tree (from 0), and the depth
    of the tree."""
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID))
    bit = F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int")
    located = rows.withColumns({"word": word, "bit": bit})
    bitmap = materialize(located.groupBy("tree", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n")))
    wider = {f"d{k}": F.shiftright("word", by) for k, by in enumerate(_WIDER)}
    base = places(bitmap.withColumns(wider), ["tree"], [*wider, "word"]).select("tree", "word", "before")
    repeated = bitmap.filter(F.bit_count("bits") < F.col("n")).select("tree", "word")
    ids = located.join(repeated, ["tree", "word"], "left_semi").groupBy("tree", "word", "bit").agg(F.count(F.lit(1)).alias("n"))
    extra = ids.filter("n > 1").groupBy("tree", "word").agg(F.collect_list(F.struct("bit", "n")).alias("extra"))  # 64 at most
    sizes = materialize(bitmap.groupBy("tree").agg(depth_of(F.sum("n")).alias("depth")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_TREES else sizes
    directory = materialize(bitmap.select("tree", "word", "bits").join(base, ["tree", "word"]).join(extra, ["tree", "word"], "left").join(sizes, "tree"))
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    more = F.aggregate(F.filter("extra", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda n, x: n + x["n"] - 1)
    again = F.coalesce(F.exists("extra", lambda x: x["bit"] == F.col("bit")), F.lit(False))
    found = located.join(directory, ["tree", "word"]).select(*rows.columns, "depth", (F.col("before") + below + F.coalesce(more, F.lit(0))).alias("r"), again.alias("again"))
    if directory.filter("extra is not null").isEmpty():
        return found.drop("again")
    equal = materialize(among_equals(found.filter("again")))
    return found.join(equal, "row", "left").withColumn("r", F.col("r") + F.coalesce("nth", F.lit(0))).drop("again", "nth")


def among_equals(rows: DataFrame) -> DataFrame:
    """row and nth: the place (from 0) of each row among those of its tree and doc_id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    keyed = rows.select("row", "tree", key.alias("key"), F.substring("leaf", 1, 4).alias("d0"), F.substring("leaf", 5, 28).alias("d1"), F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("d2"))
    keyed = materialize(keyed)
    group, digits = ["tree", "key"], ["d0", "d1", "d2"]
    before = places(keyed.groupBy(*group, *digits).agg(F.count(F.lit(1)).alias("n")), group, digits)
    last = W.partitionBy(*group, *digits).orderBy("row")
    return keyed.withColumn("k", F.row_number().over(last) - 1).join(before, group + digits).select("row", (F.col("before") + F.col("k")).alias("nth"))


def depth_of(n: Column) -> Column:
    """Levels that reduce n nodes to one: the digits of n - 1 to the base CHILDREN."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, CHILDREN))).otherwise(0)


def runs(nodes: DataFrame) -> DataFrame:
    """tree, q (number of the run), depth (levels above these nodes) and slots: the nodes of a run,
    in order. `nodes`: tree, r, depth, h, and more, which the slots hold too."""
    more = [c for c in nodes.columns if c not in ("tree", "r", "depth")]
    slot = F.struct((F.col("r") % RUN).cast("int").alias("k"), *more)
    grouped = nodes.groupBy("tree", F.expr(f"r div {RUN}").alias("q")).agg(F.first("depth").alias("depth"), F.array_sort(F.collect_list(slot)).alias("slots"))
    return grouped  # RUN slots at most


def with_levels(table: DataFrame) -> DataFrame:
    """Runs with l1 and on, the digests of each level; beyond `depth` a level repeats the one below."""
    for k in range(LEVELS):
        below = row_of(k)
        numbers = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / CHILDREN).cast("int"))
        parents = F.transform(numbers, lambda j: F.sha2(F.array_join(F.slice(below, j * CHILDREN + 1, CHILDREN), ""), 256))  # noqa: B023
        table = table.withColumn(f"l{k + 1}", F.when(F.col("depth") > k, parents).otherwise(below))
    return table


def row_of(level: int) -> Column:
    """The digests of a level of a run."""
    return F.col(f"l{level}") if level else F.col("slots.h")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written runs of each LEVELS levels, from the leaves on, and tree, h of the roots."""
    out, roots = [], None
    while True:
        table = materialize(with_levels(runs(nodes)))
        out.append(table)
        done = table.filter(F.col("depth") <= LEVELS).select("tree", F.element_at(f"l{LEVELS}", 1).alias("h"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = table.filter(F.col("depth") > LEVELS).select("tree", F.col("q").alias("r"), (F.col("depth") - LEVELS).alias("depth"), F.element_at(f"l{LEVELS}", 1).alias("h"))
        if nodes.isEmpty():
            return out, roots


_STEPS = "array<struct<left:string,right:string>>"


def steps_of(k: Column) -> Column:
    """What stands left and right of the node of slot `k` in its run on each level, up to the top."""
    out = []
    for level in range(LEVELS):
        at = F.shiftright(k, 3 * level)
        first = at - at % CHILDREN
        step = F.struct(F.array_join(F.slice(row_of(level), first + 1, at - first), "").alias("left"), F.array_join(F.slice(row_of(level), at + 2, first + CHILDREN - at - 1), "").alias("right"))
        out.append(F.when(F.col("depth") > level, step))
    return F.filter(F.array(*out), lambda s: s.isNotNull()).cast(_STEPS)


def slots_of(table: DataFrame, *fields: str) -> DataFrame:
    """The slots of runs, with tree, r, their steps to the top and what else came down the tree."""
    one = F.transform("slots", lambda s: F.struct(s["k"].alias("k"), steps_of(s["k"]).alias("own"), *(s[c].alias(c) for c in fields)))
    passed = [c for c in table.columns if c not in ("q", "depth", "slots", "steps") and not (c[0] == "l" and c[1:].isdigit())]
    rows = table.select(*passed, "q", "steps", F.explode(one).alias("slot"))
    return rows.select(*passed, (F.col("q") * RUN + F.col("slot.k")).alias("r"), F.concat("slot.own", "steps").alias("steps"), *(F.col(f"slot.{c}").alias(c) for c in fields))


def descend(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest runs, each with `steps` from its root to the top, and what else `tops` has.
    tops: tree, steps and more for each tree."""
    ways = tops.withColumn("r", F.lit(0).cast("long"))
    for table in reversed(tables[1:]):
        met = slots_of(table.join(ways.withColumnRenamed("r", "q"), ["tree", "q"]))
        low = ways.join(table.select("tree").distinct(), "tree", "left_anti")  # trees that are not so high
        ways = low.unionByName(met)
    return tables[0].join(ways.withColumnRenamed("r", "q"), ["tree", "q"])


def numbered(trees: DataFrame) -> DataFrame:
    """Trees with their place among all, in the order of their names (UTF-8)."""
    part = F.spark_partition_id().alias("part")
    ranged = materialize(trees.repartitionByRange("tree").select("*", part))
    within = ranged.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("tree")) - 1)
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    return within.join(F.broadcast(before), "part").select(*trees.columns, (F.col("r") + F.col("before")).alias("r"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row a document."""
    rows = materialize(leaves(docs))
    tables, roots = climb(ranked(rows).select("tree", "r", "depth", F.col("leaf").alias("h"), "doc_id", "told"))
    roots = materialize(numbered(roots))
    above, top = climb(roots.select(F.lit("").alias("tree"), "r", depth_of(F.lit(roots.count())).alias("depth"), "h", F.col("tree").alias("of")))
    root = top.first()
    root = F.lit(root["h"] if root else None).cast("string")
    ways = slots_of(descend(above, top.select("tree", F.array().cast(_STEPS).alias("steps"))), "of", "h")
    ways = materialize(ways.select(F.col("of").alias("tree"), F.col("h").alias("subroot"), "steps"))
    found = slots_of(descend(tables, ways), "doc_id", "h", "told")
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("told", "h"), lambda h, s: H(s["left"], h, s["right"]))
    out = found.select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
