"""Merkle manifest of a dataset, as a rollup of nested structs.

Every row is a leaf. The leaves of a source, in the order of their ids, are hashed in runs of ``FAN_OUT`` until one node
is left, the subroot; the subroots, in the order of their sources, give the root in the same way. A row's proof
is the list of its siblings, level by level, as the joined digests before and after it.

* A node's rank is written as digits in base ``FAN_OUT``. Grouping away the last digit turns a run into one
  node that holds its children as an array of structs. ``LEVELS`` digits are grouped away inside a block, which is one
  shuffle for all of them and at most ``FAN_OUT ** LEVELS`` leaves in a row.
* Block hashes are the nodes of the next segment of the tree, until every source has one block; then the same
  is done with the subroots. Tables shrink by the size of a block each time.
* On the way down the arrays are exploded again, digit by digit, with the siblings at hand: leaves are not joined. Only
  block rows (one for up to 4,096 leaves) get the path above them by a join on unique keys.
* Ranks come from a range partitioning that is written before it is counted, so that a task which is run again cannot
  deal a row anew. A source with any share of the rows is spread over many partitions and blocks.

Defined cases: NULL fields enter the leaf as ``-``, empty texts as ``0:``; texts are hashed whole; NULL sources and ids come
first; rows that repeat a source and an id are ordered by their leaf, and equal rows stand side by side, each with a proof of
its own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.llm.rows import ascii_lower
from lendwright.session import materialize

FAN_OUT = 16
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each as byte count, colon and value, or ``-``."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaves(docs: DataFrame, **carried: Column) -> DataFrame:
    """(tree, doc_id, leaf, carried columns) of every row; ``tree`` orders sources, NULL first."""
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    own = leaf_hash([F.col(f) for f in FIELDS])
    return docs.select(tree.alias("tree"), "doc_id", own.alias("leaf"), *[c.alias(name) for name, c in carried.items()])


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with their rank in their tree (from 0) and the number ``n`` of the tree's nodes."""
    spark = nodes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(partitions, "tree", *order).withColumn("part", F.spark_partition_id())
    placed = materialize(dealt, "ranges")
    whole = Window.partitionBy("tree")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    counts = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    numbered = placed.withColumn("place", place).join(counts, ["tree", "part"])
    return numbered.withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def _runs(level: int) -> Column:
    """Whether the nodes of this level of a block are hashed in runs: one node alone is done."""
    return F.col("n") > F.lit(FAN_OUT**level)


def rolled(nodes: DataFrame) -> DataFrame:
    """Blocks (tree, n, rank, hash, kids): the children nested as far as ``LEVELS`` digits go.

    ``nodes`` holds tree, n, rank, hash and inner, a struct that travels with the node.
    """
    digits = [f"d{k}" for k in range(LEVELS)]
    place = [F.expr(f"cast(rank div {FAN_OUT**k} % {FAN_OUT} as int)").alias(d) for k, d in enumerate(digits)]
    block = F.expr(f"rank div {FAN_OUT**LEVELS}").alias("block")
    rows = nodes.select("tree", "n", block, *place, "hash", "inner").repartition("tree", "block")
    for level, digit in enumerate(digits):
        kid = F.struct(digit, "hash", "inner") if level == 0 else F.struct(digit, "hash", "kids")
        rows = rows.groupBy("tree", "n", "block", *digits[level + 1 :]).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        joined = digest(F.concat_ws("", F.col("kids.hash")))
        rows = rows.withColumn("hash", F.when(_runs(level), joined).otherwise(F.col("kids")[0]["hash"]))
    return rows.withColumnRenamed("block", "rank")


def segments(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of all segments of the trees, from the leaves up; in the last one every tree is one block."""
    found = [materialize(rolled(nodes), "blocks")]
    size = FAN_OUT**LEVELS
    while (found[-1].agg(F.max("n")).first()[0] or 0) > size:
        above = found[-1].select("tree", F.expr(f"(n + {size - 1}) div {size}").alias("n"), "rank", "hash", F.struct("rank").alias("inner"))
        found.append(materialize(rolled(above), "blocks"))
    return found


def _unrolled(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The nodes below blocks that know the ``path`` above them, with their own path."""
    rows = blocks
    for level in reversed(range(LEVELS)):
        inner = "inner" if level == 0 else "kids"
        opened = rows.select("tree", "n", "path", *keep, F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("i", "kid"))
        before = F.concat_ws("", F.slice("hashes", F.lit(1), F.col("i")))
        after = F.concat_ws("", F.slice("hashes", F.col("i") + 2, F.lit(FAN_OUT)))
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        path = F.when(_runs(level), F.concat(step, "path")).otherwise(F.col("path"))
        rows = opened.select("tree", "n", path.alias("path"), *keep, F.col("kid.hash").alias("hash"), F.col(f"kid.{inner}").alias(inner))
    return rows


def with_paths(found: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves below ``segments``, with paths. ``tops`` holds tree, path and what else is true of a whole tree."""
    keep = [c for c in tops.columns if c not in ("tree", "path")]
    above = tops
    for k in reversed(range(len(found))):
        on = ["tree"] if k == len(found) - 1 else ["tree", "rank"]
        below = _unrolled(found[k].drop("hash").join(above, on), keep)
        if k == 0:
            return below
        above = below.select("tree", F.col("inner.rank").alias("rank"), "path", *keep)
    raise ValueError("NO_SEGMENTS")


def proofs(given: DataFrame) -> DataFrame:
    """Columns of ``leaves``, and subroot, root and path: steps from the leaf to the root with the joined siblings around."""
    carried = [c for c in given.columns if c not in ("tree", "leaf")]
    nodes = ranked(given, ["doc_id", "leaf"])
    found = segments(nodes.select("tree", "n", "rank", F.col("leaf").alias("hash"), F.struct(*carried).alias("inner")))
    sources = found[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "hash")
    order = ranked(sources, ["source_tree"])
    upper = segments(order.select("tree", "n", "rank", "hash", F.struct("source_tree").alias("inner")))
    root = upper[-1].select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    tops = with_paths(upper, root).select(F.col("inner.source_tree").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    return with_paths(found, tops).select("tree", F.col("hash").alias("leaf"), "inner.*", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings(path: Column) -> Column:
    """All digests of a path, left to right, level by level."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda step: F.array(step["before"], step["after"]))))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of every row."""
    return proofs(leaves(docs, source=F.col("source"))).select("doc_id", "source", "leaf", "subroot", "root", "path")


def report(docs: DataFrame, tampered: Column) -> DataFrame:
    """Digest columns for all rows; where ``tampered`` holds, the check reads the text with A-Z lower-cased."""
    lowered = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    changed = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").rlike("[A-Z]"), leaf_hash(lowered))
    found = proofs(leaves(docs, changed=changed))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
