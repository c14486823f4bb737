"""N-gram Jaccard join by signature trees, to components.

The set of a text is its distinct runs of ``SHINGLE_WORDS`` words (A-Z lower-cased); a text of fewer words is one shingle.
Two texts are linked if they share at least ``LEAST`` of the shingles that either has. Texts of equal sets form one
class before anything is compared.

A signature tree holds classes in the order of their sizes. A node has the OR of its members' token bitmaps, the range of
their sizes, the most tokens that a member hides behind set bits, and the component its members share, if they do. Two
nodes can hold a link only if their sizes are compatible and the bits they have in common, plus the hidden tokens, reach the
overlap that the smallest members need; all other pairs of nodes are left out with everything below them, as are
nodes inside one component. Pairs of leaves that remain are verified by their texts.

One tree over everything would compare in vain, so there is a forest: linked sets share one of their first tokens in any fixed
order of all tokens (|A| - ceil(0.85 |A|) + 1 of them), and every such token is a tree of the classes that hold it there.

1. *Order.* Tokens that many texts share come last, so that a passage of many documents roots no tree unless a text consists of
   such passages. The list of these tokens has at most 2^20 entries by its threshold; it changes costs, never results.
2. *Homes.* Every class visits two of its trees only, in chunks, and every tree proposes at most one pair for each of its classes. That
   joins copies to components at linear cost.
3. *Mixed trees.* Trees whose classes are now in one component are done. Of those with equal members one stays. The rest is traversed
   against itself; a tree of more than ``CHUNK`` classes is cut into chunks by size, component and hash, and pairs of chunks
   are traversed, except within one component and between incompatible sizes. No task holds more than two chunks.
4. *Groups.* Every mixed tree proposes at most one pair for each of its classes, which joins all that its bitmaps cannot tell apart.
   Components of these pairs are groups: a link that is still missing lies in one of them. Each group is a tree again, to which the sets
   themselves travel, once for each class (a large group is cut as above, and by its tokens). Its pairs are decided where they are
   found, by the sets, and leave the task as links that join components. So many near copies that are not near enough cost
   comparisons in memory, but no rows.

A bitmap has four to eight bits for a token and is all that travels to the other trees.

The result is exact but for 64-bit hashes of shingles. Defined cases: NULL, empty and blank texts have an empty set and link with
nothing; rows with a NULL id get the component of their text, and an id is never NULL where the component holds any
other; repeated rows are one class; whole texts are read, a long one in a piece of its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.llm.components import components
from lendwright.llm.rows import K1, K2, row_hashes
from lendwright.llm.words import Words, gram_hashes, mix, pieces, words
from lendwright.operators.order_statistics import join_unique
from lendwright.session import materialize

SHINGLE_WORDS = 4
#: Shared shingles / all shingles, as a fraction of whole numbers.
LEAST = (85, 100)
CHUNK = 1024
#: Tokens of a chunk whose sets travel with it, on average.
CHUNK_TOKENS = 1 << 20
FAN_OUT = 4
#: Least bits of a bitmap for each token; widths are powers of two between these.
BITS_PER_TOKEN = 4
LEAST_BITS, MOST_BITS = 64, 1 << 20
#: A token is common if it is found more often than one in so many tokens is.
COMMON_SHARE = 1 << 20
#: Tokens are counted for that if so many texts of a piece share them.
COMMON_IN_PIECE = 3
_SLICE_BYTES = 1 << 24


def shingle_sets(found: Words, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in ascending order, text after text, and the first of each text."""
    h, counts = found.hashes(), found.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(h, n)
    own = doc[: len(grams)]
    inside = own == doc[n - 1 :][: len(grams)]
    values, owners = [grams[inside]], [own[inside]]
    for row in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        values.append(gram_hashes(h[found.first[row] : found.first[row + 1]], int(counts[row])))
        owners.append(np.array([row]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def _shared_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            value, _ = shingle_sets(words(piece.column(0), lower=True))
            token, n = np.unique(value, return_counts=True)
            many = n >= COMMON_IN_PIECE
            tokens = pa.array(np.append(token[many].view(np.int64), 0), mask=np.append(np.zeros(int(many.sum()), bool), True))
            yield pa.RecordBatch.from_arrays([tokens, pa.array(np.append(n[many], len(value)).astype(np.int64))], names=["token", "n"])


def common_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens to put last, ascending: found in more than one of ``COMMON_SHARE`` places, hence at most that many."""
    found = materialize(docs.select("text").mapInArrow(_shared_in_pieces, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "common")
    total = found.where("token IS NULL").agg(F.max("n")).first()[0] or 0
    least = max(total // COMMON_SHARE + 1, 8 * COMMON_IN_PIECE)
    tokens = found.where((F.col("n") >= least) & F.col("token").isNotNull()).select("token").toArrow().column(0).to_numpy()
    return np.sort(tokens.view(np.uint64))


def prefix_length(size: np.ndarray) -> np.ndarray:
    """So many first tokens of a set meet those of every set it is linked with."""
    share, of = LEAST
    return size + (-size * share) // of + 1


def bitmaps(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Token bitmap of every set; a token sets the bit that its low bits name."""
    size = np.diff(first)
    width = np.full(len(size), LEAST_BITS, np.int64)
    while True:
        narrow = (width < size * BITS_PER_TOKEN) & (width < MOST_BITS)
        if not narrow.any():
            break
        width[narrow] *= 2
    begin = np.concatenate([[0], np.cumsum(width)])
    marks = np.zeros(begin[-1], bool)
    doc = np.repeat(np.arange(len(size)), size)
    marks[begin[doc] + (value & (width[doc] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(marks, bitorder="little").tobytes()
    edges = (begin >> 3).tolist()
    return [packed[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _sets(common) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                value, first = shingle_sets(words(piece.column(1), lower=True))
                size = np.diff(first)
                doc = np.repeat(np.arange(len(size)), size)
                late = np.zeros(len(value), np.int64)
                if len(last) and len(value):
                    late = (last[np.minimum(np.searchsorted(last, value), len(last) - 1)] == value).astype(np.int64)
                order = np.argsort(2 * doc + late, kind="stable")
                place = np.arange(len(value)) - first[:-1][doc]
                take = np.where(size > 0, prefix_length(size), 0)
                prefix = value[order][place < take[doc]]
                name = np.zeros((2, len(piece)), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    name[0, full] = np.add.reduceat(mix(value), first[:-1][full])
                    name[1, full] = np.add.reduceat(mix(value ^ np.uint64(0x9E3779B97F4A7C15)), first[:-1][full])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(prefix.view(np.int64)))
                columns = [piece.column(0), piece.column(2), piece.column(3), *[pa.array(x.view(np.int64)) for x in name]]
                columns += [pa.array(size.astype(np.int32)), lists, pa.array(bitmaps(value, first), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", K1, K2, "class", "other", "size", "prefix", "bits"])

    return run


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, row key, class, other, size, prefix, bits) of every row; ``other`` is a second hash of the class."""
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_hashes())
    schema = f"doc_id long, {K1} long, {K2} long, class long, other long, size int, prefix array<long>, bits binary"
    return given.mapInArrow(_sets(common), schema)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    share, of = LEAST
    for batch in batches:
        for part in pieces(batch, "text_a", "text_b"):
            sets = [shingle_sets(words(part.column(c), lower=True)) for c in (2, 3)]
            near = np.zeros(len(part), bool)
            for row in range(len(part)):
                a, b = (value[first[row] : first[row + 1]] for value, first in sets)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near[row] = both * of >= (len(a) + len(b) - both) * share
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near))


def class_texts(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text) of (class, row key)."""
    return docs.select("text", *row_hashes()).join(classes, [K1, K2]).dropDuplicates(["class"]).select("class", "text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose texts are linked; ``classes`` holds (class, row key)."""
    wanted = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi")
    texts = materialize(class_texts(wanted, docs), "class-texts")
    first, second = (texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_similar, "a long, b long")


@dataclass
class Level:
    """Nodes of one level of a tree."""

    least: np.ndarray
    most: np.ndarray
    hidden: np.ndarray
    component: np.ndarray
    bits: np.ndarray


class Tree:
    """Signature tree of some sets, given in the order of their sizes with bitmaps of one width. Level 0 holds the sets themselves."""

    def __init__(self, size: np.ndarray, component: np.ndarray, bits: np.ndarray):
        hidden = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [Level(size, size, hidden, component, bits)]
        while len(self.levels[-1].least) > FAN_OUT:
            below = self.levels[-1]
            at = np.arange(0, len(below.least), FAN_OUT)
            low, high = np.minimum.reduceat(below.component, at), np.maximum.reduceat(below.component, at)
            self.levels.append(
                Level(
                    np.minimum.reduceat(below.least, at),
                    np.maximum.reduceat(below.most, at),
                    np.maximum.reduceat(below.hidden, at),
                    np.where((low == high) & (low >= 0), low, -1),
                    np.bitwise_or.reduceat(below.bits, at, axis=0),
                )
            )


def _children(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``nodes``, child) of all children."""
    child = nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)
    where, _ = np.nonzero(child < below)
    return where, child[child < below]


def _pruned(a: Level, b: Level, i: np.ndarray, j: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of nodes that can hold a link, and their greatest overlap."""
    share, of = least
    able = (a.most[i] * of >= b.least[j] * share) & (b.most[j] * of >= a.least[i] * share)
    able &= (a.component[i] != b.component[j]) | (a.component[i] < 0)
    i, j = i[able], j[able]
    common = np.zeros(len(i), np.int64)
    step = max(1, _SLICE_BYTES // (8 * a.bits.shape[1]))
    for begin in range(0, len(i), step):
        part = slice(begin, begin + step)
        common[part] = np.bitwise_count(a.bits[i[part]] & b.bits[j[part]]).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(common + np.minimum(a.hidden[i], b.hidden[j]), np.minimum(a.most[i], b.most[j]))
    reached = overlap * (share + of) >= (a.least[i] + b.least[j]) * share
    return i[reached], j[reached], overlap[reached]


def dual_traversal(a: Tree, b: Tree, least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets that may be linked, with their greatest overlap. A tree against itself gives every pair once."""
    same = a is b
    m, n = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a.levels[m].least)), np.arange(len(b.levels[n].least)), indexing="ij"))
    while True:
        # A node meets itself as long as it has children to compare.
        ordered = (i < j) | ((i == j) & (m > 0)) if same else np.ones(len(i), bool)
        i, j, overlap = _pruned(a.levels[m], b.levels[n], i[ordered], j[ordered], least)
        if m == n == 0:
            return i, j, overlap
        if m >= n:
            where, child = _children(i, len(a.levels[m - 1].least))
            i, j = child, j[where]
        if n >= m:
            where, child = _children(j, len(b.levels[n - 1].least))
            i, j = i[where], child
        m, n = (m - 1 if m >= n else m), (n - 1 if n >= m else n)


def _candidates(
    size: np.ndarray, component: np.ndarray, side: np.ndarray, bits: list[bytes], least: tuple[int, int] = LEAST
) -> tuple[np.ndarray, ...]:
    """Pairs (i, j, overlap) that may be linked: between sides 0 and 1, or inside side 0 if there is no other.

    Linked sets have bitmaps of one width or of neighbouring ones; then the wider one is folded.
    """
    width = np.array([len(x) for x in bits])
    found = []

    def planes(rows: np.ndarray, narrow: int) -> np.ndarray:
        plane = np.frombuffer(b"".join(bits[r] for r in rows.tolist()), np.uint64).reshape(len(rows), -1)
        return plane if plane.shape[1] * 8 == narrow else plane[:, : narrow // 8] | plane[:, narrow // 8 :]

    sides = [np.flatnonzero(side == s) for s in (0, 1)]
    alone = not len(sides[1])
    others = sides[0] if alone else sides[1]
    for w in np.unique(width).tolist():
        for v in (w // 2, w, 2 * w):
            a, b = sides[0][width[sides[0]] == w], others[width[others] == v]
            if not len(a) or not len(b) or (alone and v < w):
                continue
            first = Tree(size[a], component[a], planes(a, min(w, v)))
            second = first if alone and v == w else Tree(size[b], component[b], planes(b, min(w, v)))
            i, j, overlap = dual_traversal(first, second, least)
            found.append((a[i], b[j], overlap))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))


def _spanning(i: np.ndarray, j: np.ndarray, overlap: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most promising pairs that join what all pairs would join: every part takes its best pair to another one, until none is left."""
    order = np.argsort(-overlap, kind="stable")
    i, j = i[order], j[order]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept, live = np.zeros(len(i), bool), np.arange(len(i))
    while len(live):
        best = np.full(n, len(i))
        part = np.array([find(x) for x in range(n)])
        a, b = part[i[live]], part[j[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        for k in np.unique(best[best < len(i)]).tolist():
            kept[k] = True
            root[find(int(i[k]))] = find(int(j[k]))
    return i[kept], j[kept]


def _joining(i: np.ndarray, j: np.ndarray, sets: list[bytes], component: np.ndarray, least: tuple[int, int]) -> tuple[list[int], list[int]]:
    """The linked ones of these pairs, as far as they join components."""
    share, of = least
    size = np.array([len(x) // 8 for x in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    distinct, token = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    token = token.astype(np.int32)
    own, root = np.zeros(len(distinct), bool), component.copy()
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    out: tuple[list[int], list[int]] = ([], [])
    for a, others in zip(i[at].tolist(), np.split(j, at[1:])):
        mine = token[first[a] : first[a + 1]]
        own[mine] = True
        load = np.cumsum(size[others])
        for part in np.split(others, np.flatnonzero(np.diff(load // (_SLICE_BYTES // 8))) + 1):
            part = part[root[part] != root[a]]
            if not len(part):
                continue
            begin = np.cumsum(size[part]) - size[part]
            where = np.repeat(first[part] - begin, size[part]) + np.arange(begin[-1] + size[part[-1]])
            both = np.add.reduceat(own[token[where]], begin, dtype=np.int64)
            for b in part[both * of >= (size[a] + size[part] - both) * share].tolist():
                if root[a] != root[b]:
                    root[root == root[b]] = root[a]
                    out[0].append(a)
                    out[1].append(b)
        own[mine] = False
    return out


def _traverse(least: tuple[int, int], exact: bool) -> Callable:
    """Pairs from the trees that arrive one after another, each in the order of its sizes."""

    def close(held: list[tuple], found: list[tuple[int, int]]) -> None:
        side, name, root, size = (np.array([h[c] for h in held], np.int64) for c in range(4))
        if len(held) < 2 or (root == root[0]).all():
            return
        _, component = np.unique(root, return_inverse=True)
        i, j, overlap = _candidates(size, component, side, [h[4] for h in held], least)
        i, j = _joining(i, j, [h[5] for h in held], component, least) if exact else _spanning(i, j, overlap, len(held))
        found += [(min(a, b), max(a, b)) for a, b in ((int(name[x]), int(name[y])) for x, y in zip(i, j))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = batch.column(0).to_pylist()
            for own, *row in zip(keys, *[batch.column(c).to_pylist() for c in range(1, batch.num_columns)]):
                if own != key:
                    if held:
                        close(held, found)
                    held, key = [], own
                held.append(tuple(row))
            yield _pairs(found)
        found = []
        if held:
            close(held, found)
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])


def traversed(
    members: DataFrame, signatures: DataFrame, least: tuple[int, int] = LEAST, sets: DataFrame | None = None
) -> DataFrame:
    """Distinct pairs (a < b) of the trees of ``members`` (tree, side, class, root, size); ``least`` is the similarity of a link, at
    least a half. They are candidates that join what all candidates of a tree join, or, with ``sets`` (class, tokens), links that join
    the components that all links of a tree join."""
    full = members.join(signatures, "class")
    if sets is not None:
        full = full.join(sets, "class")
    full = full.select("tree", "side", "class", "root", "size", "bits", *([] if sets is None else ["tokens"]))
    dealt = full.repartition("tree").sortWithinPartitions("tree", "side", "size", "class")
    return dealt.mapInArrow(_traverse(least, sets is not None), "a long, b long").distinct()


def _sizes_meet(a_least: Column, a_most: Column, b_least: Column, b_most: Column, least: tuple[int, int]) -> Column:
    share, of = least
    return (a_most.cast("long") * of >= b_least * share) & (b_most.cast("long") * of >= a_least * share)


def mixed_trees(member: DataFrame, least: tuple[int, int] = LEAST, tokens: int | None = None) -> DataFrame:
    """(tree, side, class, root, size) of what has to be compared across components, from (token, class, size, root).

    A chunk has about ``CHUNK`` classes at most, and ``tokens`` tokens if that is given.
    """

    def chunks(n: Column, t: Column) -> Column:
        return F.ceil(n / CHUNK if tokens is None else F.greatest(n / CHUNK, t / tokens))

    trees = member.groupBy("token").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("t"),
        F.min("root").alias("r"),
        F.max("root").alias("s"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
    )
    kept = trees.where("r <> s").groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.max("t").alias("t"))
    kept = kept.select("token", chunks(F.col("n"), F.col("t")).alias("parts"))
    rows = materialize(member.join(kept, "token"), "mixed-trees")
    small = rows.where("parts <= 1").select(F.array("token").alias("tree"), F.lit(0).alias("side"), "class", "root", "size")

    # Sizes of linked sets are in the same class of sizes or in neighbouring ones.
    step = float(np.log(least[1] / least[0]) + 1e-9)
    large = rows.where("parts > 1").withColumn("z", F.floor(F.log("size") / F.lit(step)))
    shares = large.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    large = large.join(shares, "token").withColumn("other", (F.col("root") != F.col("main")).cast("int")).drop("main", "parts")
    cells = large.groupBy("token", "z", "other").agg(chunks(F.count("*"), F.sum("size")).alias("parts"))
    large = large.join(cells, ["token", "z", "other"])
    chunk = F.pmod(F.xxhash64("class"), F.col("parts")) * 2 + F.col("other")
    large = materialize(large.select("token", "z", chunk.alias("chunk"), "class", "root", "size"), "chunks")
    nodes = large.groupBy("token", "z", "chunk").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("root").alias("r"), F.max("root").alias("s")
    )
    a, b = (nodes.select("token", *[F.col(c).alias(f"{c}{side}") for c in nodes.columns[1:]]) for side in "ab")
    later = (F.col("zb") == F.col("za") + 1) | ((F.col("zb") == F.col("za")) & (F.col("chunkb") >= F.col("chunka")))
    one = (F.col("ra") == F.col("sa")) & (F.col("rb") == F.col("sb")) & (F.col("ra") == F.col("rb"))
    able = _sizes_meet(F.col("loa"), F.col("hia"), F.col("lob"), F.col("hib"), least)
    pairs = materialize(a.join(b, "token").where(later & able & ~one).select("token", "za", "chunka", "zb", "chunkb"), "chunk-pairs")
    tree = F.array("token", "za", "chunka", "zb", "chunkb").alias("tree")
    self_ = (F.col("za") == F.col("zb")) & (F.col("chunka") == F.col("chunkb"))
    sides = []
    for number, (z, c) in enumerate((("za", "chunka"), ("zb", "chunkb"))):
        wanted = pairs if number == 0 else pairs.where(~self_)
        joined = large.join(wanted.withColumn("z", F.col(z)).withColumn("chunk", F.col(c)), ["token", "z", "chunk"])
        sides.append(joined.select(tree, F.lit(number).alias("side"), "class", "root", "size"))
    return small.unionByName(sides[0]).unionByName(sides[1])


def token_sets(texts: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(class, tokens) of (class, text): the distinct shingles as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                value, first = shingle_sets(words(piece.column(1), lower=True), n)
                tokens = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(tokens, pa.binary())], names=["class", "tokens"])

    return texts.select("class", "text").mapInArrow(run, "class long, tokens binary")


def joining_links(
    member: DataFrame, signatures: DataFrame, sets: Callable[[DataFrame], DataFrame], least: tuple[int, int] = LEAST
) -> DataFrame:
    """Linked pairs (a, b) that join the components which any links in the trees of ``member`` (token, class, size, root) join.

    ``sets`` gives (class, tokens) of the classes in its argument.
    """
    near = materialize(traversed(mixed_trees(member, least), signatures, least), "tree-pairs")
    groups = components(near).select(F.col("node").alias("class"), F.col("root").alias("token"))
    grouped = member.select("class", "size", "root").join(groups, "class").dropDuplicates(["class"])
    grouped = materialize(grouped.select("token", "class", "size", "root"), "groups")
    return traversed(mixed_trees(grouped, least, CHUNK_TOKENS), signatures, least, sets(grouped.select("class")))


def class_links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that join all linked classes to components."""
    classes = sets.where("size > 0").groupBy("class").agg(
        F.min(F.struct(K1, K2)).alias("row"),
        F.first("size").alias("size"),
        F.first("prefix").alias("prefix"),
        F.first("bits").alias("bits"),
        (F.min("other") < F.max("other")).alias("collides"),
    )
    classes = materialize(classes.select("class", f"row.{K1}", f"row.{K2}", "size", "prefix", "bits", "collides"), "classes")
    if not classes.where("collides").isEmpty():
        raise ValueError("CLASS_HASH_COLLISION")
    postings = classes.select("class", "size", F.explode("prefix").alias("token"))
    in_tree = Window.partitionBy("token").orderBy("size")
    met = postings.select("*", F.lag("size").over(in_tree).alias("before"), F.lead("size").over(in_tree).alias("after"))
    size = F.col("size").cast("long")
    near = (F.col("before") * LEAST[1] >= size * LEAST[0]) | (size * LEAST[1] >= F.col("after").cast("long") * LEAST[0])
    shared = materialize(met.where(near).select("token", "class", "size"), "shared-tokens")
    rows, signatures = classes.select("class", K1, K2), classes.select("class", "bits")

    homes = F.array(F.min("token"), F.min_by("token", F.xxhash64("token")))
    visits = shared.groupBy("class").agg(F.first("size").alias("size"), F.array_distinct(homes).alias("homes"))
    visits = materialize(visits.select("class", "size", F.explode("homes").alias("token")), "visits")
    visitors = visits.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    # Dealt anew in each home, so that parts of one home meet in the other.
    part = F.pmod(F.xxhash64("class", "token"), F.col("parts"))
    visits = visits.join(visitors, "token").select(
        F.array("token", part).alias("tree"), F.lit(0).alias("side"), "class", F.col("class").alias("root"), "size"
    )
    tried = materialize(traversed(visits, signatures), "home-pairs")
    first = materialize(verified(tried, rows, docs), "home-links")

    roots = components(first)
    member = shared.join(roots, F.col("class") == F.col("node"), "left")
    member = materialize(member.select("token", "class", "size", F.coalesce("root", "class").alias("root")), "tree-members")
    rest = joining_links(member, signatures, lambda wanted: token_sets(class_texts(rows.join(wanted, "class", "left_semi"), docs)))
    return first.union(rest)


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, row key, class, size, root, component_id) of every row; ``component_id`` is the smallest id that links lead to.

    ``root`` names the component; it is NULL for an empty set.
    """
    sets = materialize(shingled(docs), "shingle-sets")
    roots = components(class_links(sets, docs))
    found = sets.select("doc_id", K1, K2, "class", "size")
    classes = found.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(least, "root").select("class", "root", "component_id")
    full = join_unique(found.where("size > 0"), rooted, ["class"], how="inner")
    # An empty set links with nothing, not even with its like.
    empty = found.where("size = 0").select("*", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def report(docs: DataFrame) -> DataFrame:
    found = linked_components(docs.select("doc_id", "text"))
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
