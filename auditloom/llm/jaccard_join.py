"""N-gram Jaccard self-join with signature trees.

A document's set holds the 64-bit hashes of its different ``n``-word shingles.  Documents with equal sets are one class.

1. *Sketches.*  Each class keeps its ``SKETCH`` smallest hashes: a set of up to that size whole, a larger one as a uniform sample.  Two sets of similarity 0.8
      share at least the fraction p = 4/9 * (n + m) / max(n, m) of the larger one, so the sketch with the smaller range shares a binomial number with p; a number
   ``SIGMAS`` deviations below the mean has a chance of about 1e-13, and none at all a far smaller one.  Candidates are the pairs that share enough.
2. *Leaders.*  The smallest class with a hash leads that hash.  Pairs with a leader are tested first, as many as there are shared hashes.  Their components
   hold nearly all large groups of near copies.
3. *Trees.*  Classes of one hash that are not yet in one component are joined block by block.  In a block a signature tree is built over the
   sketches: a node holds the OR of its token bitmaps, its range of sizes and its components.  A dual traversal from (root, root) drops
   a pair of nodes whose sizes, largest possible overlap or single common component rule out a new link.  A block with more
   candidates than twice its classes passes its classes on instead, and is joined again on whole sets, giving only links that join components.
4. *Verification.*  Pairs of sets larger than a sketch are compared in full, on hashes made again from the whole texts of the classes concerned.
5. *Link counts.*  All links lie inside components.  A component's classes are compared on whole sets, block by block, and only counts leave a block.

A hash in very many components (a passage that unrelated documents share) is left out for classes that keep at least ``ENOUGH`` other
sketch hashes.  A similar class is missed only if all common hashes of the two sketches are among those left out, so that ``ENOUGH`` of 48 sketch
hashes or more lie in the fifth of the union, at most, that the pair does not share: a chance below 2e-12 a pair, and the largest of this join besides
equal 64-bit hashes of different shingles.  Groups of more than ``BLOCK`` classes are cut into bands of sizes, of which only neighbours can link, and the bands
into parts; blocks are pairs of parts.

Defined cases: a null, empty or blank text has an empty set, size 0 and is linked with nothing; a text of fewer words than ``n`` is one shingle; equal
texts are in one component and linked; rows that repeat an id are judged by their texts and each has its row; a null id is the smallest of no component; an
empty table yields no rows; other columns, whatever their names, pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import textscan
from auditloom.llm.components import components
from auditloom.llm.support import materialize, text_or_empty, without_copies

SKETCH = 48
SIGMAS = 8
ENOUGH = 32
HOT = 512  # components
BLOCK = 1024  # classes
VOLUME = 1_000_000  # hashes of whole sets in a part
COLUMNS = 4096  # hashes counted at a time
DENSE_HASHES = 4_000_000  # in the whole sets of a block that is joined on them
BROADCAST_ROWS = 200_000
LEAF = 16
FAN = 8


# -- sets ------------------------------------------------------------------------------------------------------------
def shingle_sets(group: textscan.Group, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's different shingle hashes in ascending order."""
    hashes, counts = group.word_hashes(lower=True), group.words_per_text()
    keys, at = textscan.ngrams(hashes, group.doc, n)
    found, owner = [keys], [group.doc[at]]
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    for k in range(1, n):  # shorter texts are one shingle
        short = np.flatnonzero(counts == k)
        if len(short):
            index = (first[short][:, None] + np.arange(k)).ravel()
            whole, _ = textscan.ngrams(hashes[index], group.doc[index], k)
            found.append(whole)
            owner.append(short)
    keys, doc = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=group.size)))).astype(np.int64)


def _sums(keys: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(textscan.mix(keys ^ np.uint64(salt)), dtype=np.uint64)))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def sketches(docs: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, version, n_shingles, d1, d2, sketch, row): the size, a 128-bit digest and the smallest hashes of each text's set.

    ``version`` is a hash of the text, ``row`` tells rows apart.
    """
    source = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("version"), text_or_empty(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in textscan.groups(batch.column(2)):
                keys, offsets = shingle_sets(group, n)
                sizes = np.diff(offsets)
                rank = np.arange(len(keys)) - np.repeat(offsets[:-1], sizes)
                kept = np.concatenate(([0], np.cumsum(np.minimum(sizes, SKETCH)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(kept), pa.array(keys[rank < SKETCH].view(np.int64)))
                own = [c.slice(group.first, group.size) for c in batch.columns[:2]]
                numbers = [pa.array(x) for x in (sizes, _sums(keys, offsets, 1), _sums(keys, offsets, 2))]
                yield pa.RecordBatch.from_arrays([*own, *numbers, lists], names=["doc_id", "version", "n_shingles", "d1", "d2", "sketch"])

    found = source.mapInArrow(run, "doc_id long, version long, n_shingles long, d1 long, d2 long, sketch array<long>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "sketches")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, id_col: str, text: str) -> DataFrame:
    """(rep, keys): the whole sets of the classes in ``wanted`` (rep), made again from their texts; materialised.

    A class is found by the id and the text's hash of one of its rows.
    """
    active = materialize(classes.join(wanted.distinct(), "rep").select("rep", "best.doc_id", "best.version"), "active")
    count = active.count()
    near = F.broadcast(active) if count <= BROADCAST_ROWS else active
    rows = docs.select(docs[id_col].alias("own"), text_or_empty(text).alias("body"))
    rows = rows.join(near, F.col("own").eqNullSafe(F.col("doc_id")) & (F.xxhash64("body") == F.col("version"))).select("rep", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in textscan.groups(batch.column(1)):
                keys, offsets = shingle_sets(group, n)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(group.first, group.size), lists], names=["rep", "keys"])

    found = materialize(rows.mapInArrow(run, "rep long, keys array<long>"), "sets")
    if found.count() > count:  # rows that repeat both the id and the text
        found = materialize(found.groupBy("rep").agg(F.first("keys").alias("keys")), "sets")
    return found


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, id_col: str, text: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link; ``pairs`` is materialised."""
    sets = sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("rep")), n, id_col, text)
    met = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    met = met.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("sizes"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return materialize(met.where(f"common > 0 and 100 * common >= {percent} * (sizes - common)").select("a", "b").distinct(), "verified")


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least number of common sketch hashes of sets of sizes ``a`` and ``b`` that link."""
    p = np.minimum(percent / (100 + percent) * (a + b) / np.maximum(np.maximum(a, b), 1), 1)
    return np.maximum(1, np.floor(SKETCH * p - SIGMAS * np.sqrt(SKETCH * p * (1 - p))))


# -- signature trees ---------------------------------------------------------------------------------------------------
class SignatureTree:
    """Sets in order of size; level 0 has the leaves, the last level the root."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.bits, self.sizes = bits, sizes
        packed = np.packbits(bits, axis=1)
        starts = np.arange(0, len(sizes), LEAF)
        self.starts = np.append(starts, len(sizes))
        union = np.bitwise_or.reduceat(packed, starts, axis=0)
        ends = self.starts[1:] - 1
        low, high = sizes[starts], sizes[ends]
        one, other = np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)
        self.levels = [(union, low, high, one, other)]
        while len(union) > 1:
            starts = np.arange(0, len(union), FAN)
            ends = np.append(starts[1:], len(union)) - 1
            union, low, high = np.bitwise_or.reduceat(union, starts, axis=0), low[starts], high[ends]
            one, other = np.minimum.reduceat(one, starts), np.maximum.reduceat(other, starts)
            self.levels.append((union, low, high, one, other))


def _possible(level: tuple, a: np.ndarray, b: np.ndarray, percent: int, limit: int) -> np.ndarray:
    """Which pairs of nodes may hold a new link."""
    union, low, high, one, other = level
    sizes = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
    fresh = ~((one[a] == other[a]) & (one[b] == other[b]) & (one[a] == one[b]))
    overlap = np.bitwise_count(union[a] & union[b]).sum(axis=1)
    need = -(-percent * (low[a] + low[b]) // (100 + percent))  # the overlap of two whole sets
    least = enough(np.array(100), np.array(percent), percent)  # of two sketches, at the widest ratio of sizes
    return sizes & fresh & (overlap >= np.where(np.maximum(high[a], high[b]) <= limit, need, np.minimum(least, need)))


def tree_join(bits: np.ndarray, sizes: np.ndarray, group: np.ndarray, percent: int, limit: int = SKETCH) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, sure) of the pairs of sets from different groups that may link, or surely do.

    Sets are ordered by size; those of up to ``limit`` hashes are whole, the others sketches.
    """
    tree = SignatureTree(bits, sizes, group)
    a = b = np.zeros(1, dtype=np.int64)
    for depth in range(len(tree.levels) - 1, -1, -1):
        keep = _possible(tree.levels[depth], a, b, percent, limit)
        a, b = a[keep], b[keep]
        if depth:
            count = len(tree.levels[depth - 1][0])
            grid = np.arange(FAN)
            ca = np.repeat(FAN * a[:, None] + grid, FAN, axis=1).ravel()
            cb = np.tile(FAN * b[:, None] + grid, (1, FAN)).ravel()
            keep = (ca <= cb) & (ca < count) & (cb < count)
            a, b = ca[keep], cb[keep]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        xs, ys = slice(tree.starts[x], tree.starts[x + 1]), slice(tree.starts[y], tree.starts[y + 1])
        common = (bits[xs].astype(np.float32) @ bits[ys].astype(np.float32).T).astype(np.int64)
        sx, sy = sizes[xs][:, None], sizes[ys][None, :]
        sure = (sx <= limit) & (sy <= limit)
        links = 100 * common >= percent * (sx + sy - common)
        sized = (100 * sx >= percent * sy) & (100 * sy >= percent * sx)
        ok = np.where(sure, links & (common > 0), sized & (common >= np.minimum(enough(sx, sy, percent), np.minimum(sx, sy)))) & (group[xs][:, None] != group[ys][None, :])
        if x == y:
            ok &= np.tri(len(sx), k=-1, dtype=bool).T
        i, j = np.nonzero(ok)
        if len(i):
            yield i + xs.start, j + ys.start, sure[i, j]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of edges (a, b) that form a forest with the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    left, out = len(np.unique(np.concatenate((a, b)))) - 1, []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(k)
            if len(out) == left:
                break
    return out


@dataclass
class Block:
    """The classes that share one hash, or two parts of them, in order of size."""

    ids: np.ndarray
    sizes: np.ndarray
    group: np.ndarray
    sketch: list[np.ndarray]

    def __post_init__(self) -> None:
        self.order = np.argsort(self.sizes, kind="stable")
        self.ids, self.sizes, self.group, self.sketch = self.ids[self.order], self.sizes[self.order], self.group[self.order], [self.sketch[k] for k in self.order]
        self.tokens, inverse, counts = np.unique(np.concatenate(self.sketch), return_inverse=True, return_counts=True)
        self.both = counts > 1  # hashes of one set only can be in no overlap
        self.column = np.cumsum(self.both) - 1
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.sketch])
        use = self.both[inverse]
        self.bits = np.zeros((len(self.ids), int(self.both.sum())), dtype=np.uint8)
        self.bits[owner[use], self.column[inverse[use]]] = 1

    def pairs(self, percent: int, token: int | None = None, unused: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """(i, j, sure) of the candidates.

        With ``token``, a pair comes only from the block of the smallest hash that both use: every pair comes once, or was tested with its leader.
        """
        used = self.bits
        if unused is not None and any(len(u) for u in unused):
            used = self.bits.copy()
            for row, k in enumerate(self.order):
                gone = np.searchsorted(self.tokens, unused[k])
                used[row, self.column[gone[self.both[gone]]]] = 0
        column = self.column[np.searchsorted(self.tokens, token)] if token is not None else 0
        found = []
        for pairs in tree_join(self.bits, self.sizes, self.group, percent):
            if token is not None:
                i, j = pairs[:2]
                own = np.concatenate([np.argmax(used[i[k : k + 256]] & used[j[k : k + 256]], axis=1) for k in range(0, len(i), 256)]) == column
                pairs = tuple(x[own] for x in pairs)
            found.append(pairs)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 3

    def links(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of links that join the block's groups, all sets being whole."""
        found = [p[:2] for p in tree_join(self.bits, self.sizes, self.group, percent, limit=1 << 60)]
        if not found:
            return (np.empty(0, dtype=np.int64),) * 2
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        chosen = _forest(self.group[i], self.group[j])
        return i[chosen], j[chosen]


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays; null is an empty one."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(offsets, offsets[1:], there, strict=False)]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (token, i, j, ...) sorted by block, a block at a time; lists are arrays."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(_lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _block_of(rows: list[tuple]) -> Block:
    return Block(*(np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 5)), [r[6] for r in rows])


def block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Candidates of blocks (token, i, j, rep, n, component, sketch, unused): rows (a, b, sure), or, of a dense block, its classes (a) with the block's key."""
    names = ["a", "b", "sure", "token", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            if len({r[5] for r in rows}) < 2:
                continue
            rows = list({r[3]: r for r in rows}.values())
            block = _block_of(rows)
            i, j, sure = block.pairs(percent, rows[0][0], [r[7] for r in rows])
            if len(i) > 2 * len(rows) and block.sizes.sum() <= DENSE_HASHES:
                some = block.ids[np.unique(np.concatenate((i, j)))]
                key = [pa.array([x] * len(some), pa.int64()) for x in rows[0][:3]]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.bool_()), *key], names=names)
            elif len(i):
                a, b = block.ids[i], block.ids[j]
                none = [pa.nulls(len(a), pa.int64()) for _ in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure), *none], names=names)

    return blocks.mapInArrow(run, "a long, b long, sure boolean, token long, i long, j long")


def dense_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) of links that join components of blocks (token, i, j, rep, n, component, keys) of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            block = _block_of(list({r[3]: r for r in rows}.values()))
            i, j = block.links(percent)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[i]), pa.array(block.ids[j])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


# -- the join ---------------------------------------------------------------------------------------------------------------
def _tested(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) of the pairs that the sketches allow."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.where("100 * least(n_a, n_b) >= greatest(n_a, n_b) * " + str(percent)).withColumn("common", F.size(F.array_intersect("sketch_a", "sketch_b")))
    sure = F.greatest("n_a", "n_b") <= SKETCH
    links = 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    p = F.least(F.lit(1.0), F.lit(percent / (100 + percent)) * (F.col("n_a") + F.col("n_b")) / F.greatest("n_a", "n_b"))
    least = F.least(F.greatest(F.lit(1), F.floor(SKETCH * p - SIGMAS * F.sqrt(SKETCH * p * (1 - p)))), "n_a", "n_b")
    return met.where(F.when(sure, links).otherwise(F.col("common") >= least)).select("a", "b", sure.alias("sure"))


def _linked(docs: DataFrame, classes: DataFrame, tested: DataFrame, n: int, percent: int, id_col: str, text: str) -> DataFrame:
    tested = materialize(tested, "tested")
    checked = verify(docs, classes, tested.where("not sure").select("a", "b"), n, percent, id_col, text)
    return tested.where("sure").select("a", "b").unionByName(checked)


def _celled(rows: DataFrame, key: str, percent: int, volume: int | None = None) -> DataFrame:
    """``rows`` (key, rep, n, ...), a written table, with the blocks (i, j) that they are in, and ``cell``, which is i or j.

    Groups of up to ``BLOCK`` classes (and ``volume`` hashes) are one block (0, 0).  Larger ones are cut into bands of sizes and these into parts of
    about that many.  Sets that link are in one band or in neighbours, so blocks are pairs of parts of one band or of two neighbours.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / volume) if volume else F.lit(1)).cast("int")
    big = materialize(rows.groupBy(key).agg(parts.alias("parts")).where("parts > 1").select(key), "big")
    big = F.broadcast(big) if big.count() <= BROADCAST_ROWS else big
    one = [F.lit(0).cast("long").alias(x) for x in ("i", "j", "cell")]
    small = rows.join(big, key, "left_anti").select("*", *one)
    banded = rows.join(big, key, "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int"))
    cells = materialize(banded.groupBy(key, "band").agg(parts.alias("parts")), "cells")
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
    beside = lambda d: cells.select(key, (F.col("band") - d).alias("band"), F.col("parts").alias(f"parts_{d + 1}"))
    for d in (0, -1, 1):
        banded = banded.join(beside(d), [key, "band"], "left")
    cell = lambda band, part: band.cast("long") * (1 << 32) + part
    part = F.pmod(F.xxhash64("rep"), F.col("parts_1")).cast("int")
    banded = banded.withColumn("cell", cell(F.col("band"), part))
    every = lambda d: F.transform(F.sequence(F.lit(1), F.col(f"parts_{d + 1}")), lambda k: cell(F.col("band") + d, k - 1))
    other = F.concat(every(0), *[F.when(F.col(f"parts_{d + 1}").isNotNull(), every(d)).otherwise(F.expr("cast(array() as array<bigint>)")) for d in (-1, 1)])
    banded = banded.withColumn("other", F.explode(other))
    return small.unionByName(banded.select(*rows.columns, F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell"))


def _between(shared: DataFrame, classes: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """What :func:`block_pairs` finds among the classes that share a hash and lie in two components.

    A pair with a leader has been tested, so leaders stay out, and so do hashes of two classes.
    """
    open_rows = shared.where("rep <> leader and classes > 2").join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("component"))
    spread = open_rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows")).groupBy("token").agg(F.count(F.lit(1)).alias("components")).where("components > 1")
    spread = materialize(spread, "spread")
    hot = spread.where(F.col("components") > HOT).select("token")
    many = open_rows.select("token", "rep", "n").join(hot, "token").groupBy("rep", "n").agg(F.collect_list("token").alias("unused"))
    many = materialize(many.where(F.least("n", F.lit(SKETCH)) - F.size("unused") >= ENOUGH).select("rep", "unused"), "unused")  # a sketch at most
    rows = open_rows.join(spread, "token").join(many, "rep", "left").where(F.col("unused").isNull() | (F.col("components") <= HOT))
    rows = _celled(materialize(rows.select("token", "rep", "n", "component", "unused"), "open"), "token", percent)
    blocks = rows.join(classes.select("rep", "sketch"), "rep").select("token", "i", "j", "rep", "n", "component", "sketch", "unused")
    return block_pairs(_dealt(blocks), percent)


def _dealt(blocks: DataFrame) -> DataFrame:
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, *blocks.columns[:3]).sortWithinPartitions(*blocks.columns[:3])


def linked_weights(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set, the weights of the sets that it links with; with ``left``, only those of the other side count."""
    sizes = np.array([len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    use = counts[column] > 1
    order = np.argsort(column[use], kind="stable")
    column, owner = (np.cumsum(counts > 1) - 1)[column[use]][order], owner[use][order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (a, a + COLUMNS))
        bits = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - a)), dtype=np.float32)
        bits[owner[low:high], column[low:high] - a] = 1
        common += bits @ bits.T
    links = (common > 0) & (100 * common.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - common))
    links &= ~np.eye(len(sets), dtype=bool) if left is None else left[:, None] != left[None, :]
    return links @ weights


def link_counts(docs: DataFrame, classes: DataFrame, grouped: DataFrame, n: int, percent: int, id_col: str, text: str) -> DataFrame:
    """(rep, links): how many documents of other classes each class links with, for classes with any.  Only counts leave the blocks."""
    rows = materialize(classes.join(grouped.withColumnRenamed("node", "rep"), "rep").select("component", "rep", "n", "weight"), "members")
    two = rows.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("weight").alias("all"))
    pairs = materialize(two.where("members = 2"), "pairs")  # the two are linked
    rows = rows.join(pairs, "component", "left")
    of_pairs = rows.where("members is not null").select("rep", (F.col("all") - F.col("weight")).alias("links"))
    rows = materialize(rows.where("members is null").select("component", "rep", "n", "weight"), "members")
    blocks = _celled(rows, "component", percent, VOLUME).join(sets_of(docs, classes, rows.select("rep"), n, id_col, text), "rep")
    blocks = blocks.select("component", "i", "j", "rep", "weight", "cell", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_block(batches):
            left = None if held[0][1] == held[0][2] else np.array([r[5] for r in held]) == held[0][1]
            found = linked_weights([r[6] for r in held], np.array([r[4] for r in held]), left, percent)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([held[k][3] for k in some], pa.int64()), pa.array(found[some], pa.int64())], names=["rep", "links"])

    return of_pairs.unionByName(_dealt(blocks).mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links")))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, first, version) of each row: component_id is the smallest id reachable by links, n_links the number
    of documents it links with (null without ``counts``), first whether the row is the one of its component that stays.  ``version`` is a hash of the text."""
    every = sketches(docs, n, id_col, text)
    key = ["n_shingles", "d1", "d2"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "version"))
    classes = every.where("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("rep"), best.alias("best"), F.count(F.lit(1)).alias("weight"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumnRenamed("n_shingles", "n"), "classes")

    tokens = classes.select("rep", "n", F.explode("sketch").alias("token"))
    led = tokens.groupBy("token").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    shared = materialize(tokens.join(materialize(led, "led"), "token"), "shared")
    pairs = shared.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = materialize(_linked(docs, classes, _tested(pairs, classes, percent), n, percent, id_col, text), "first-links")
    grouped = components(first)

    found = materialize(_between(shared, classes, grouped, percent), "candidates")
    pairs = found.where("b is not null").select("a", "b", "sure").distinct()  # blocks of several parts may repeat a pair
    second = _linked(docs, classes, pairs, n, percent, id_col, text)
    dense = found.where("b is null").select("token", "i", "j", F.col("a").alias("rep"))
    dense = dense.join(sets_of(docs, classes, dense.select("rep"), n, id_col, text), "rep").join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    dense = dense.select("token", "i", "j", "rep", F.size("keys").cast("long").alias("n"), F.coalesce("component", "rep").alias("component"), "keys")
    third = dense_links(_dealt(dense), percent)
    known = grouped.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    grouped = components(known.unionByName(second).unionByName(third))
    links = link_counts(docs, classes, grouped, n, percent, id_col, text) if counts else classes.select("rep", F.lit(None).cast("long").alias("links")).where("false")
    named = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(links, "rep", "left")
    named = materialize(named.select("component", "rep", F.col("n").alias("n_shingles"), "d1", "d2", "best", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "named")
    heads = named.groupBy("component").agg(F.min("best").alias("head"))
    named = named.join(heads, "component").select(*key, "head", "n_links")
    out = every.join(named, key, "left")
    number = F.when(F.lit(counts), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")
    first = F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("first")
    return out.select(every["doc_id"], "n_shingles", F.coalesce("head.doc_id", every["doc_id"]).alias("component_id"), number, first, every["version"])


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one with the smallest id, and all rows without words."""
    found = jaccard_components(docs.select(id_col, text), n, percent, id_col, text, counts=False)
    decided = found.where("n_shingles > 0").select("doc_id", F.col("version").alias("mark"), F.col("first").alias("stays"))
    return without_copies(docs, decided, F.xxhash64(text_or_empty(text)), id_col, BROADCAST_ROWS)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


#: All pairs that share a shingle, and every document's links followed to the end: for tables of a few thousand rows.
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, coalesce(any_value(l.n_links), 0) AS n_links
FROM reach LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) l USING (doc_id) GROUP BY doc_id
"""
