"""N-gram Jaccard join: rare-first prefix filter, then length, count, parity, positional and suffix filters, then one exact check of a pair.

Documents with the same shingle set are one node. The rarest shingles of a
node (its prefix) are joined on their hashes; two sets that are similar enough
must share one. A shingle's list is not expanded into pairs: its least node is
paired with the others (a star), and only nodes that are then still in
different components meet each other, in blocks. So a group of m near copies
costs about m comparisons, and no link that joins two components is lost.

Lists are walked, each by one task, but for hot ones. The least node of a hot
list is found by an aggregate that combines before its shuffle, and the
list joins it, so no task has to take it whole.

What is moved stays in proportion to the input however many near copies there
are: a list gives about a row for each of its nodes, pairs are told apart by
small sketches before any text moves, a text moves for one pair of its node
first and for others only if that left them apart, and texts move compressed;
their sets are made again where they meet. Pairs that blocks leave are told
once however many lists they share, and the nodes of most pairs come first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryweb.llm.common import bloom, bounded_batches, discard, free_name, give_back, table, written
from quarryweb.llm.words import hashed_words

WORDS = 5
#: Shingles are ranked by the number of documents in their bucket of so many; ties by hash. Any such order is exact.
BUCKETS = 1 << 20
#: The longest list of a shingle that is expanded into pairs: 1.5 rows for each of its nodes.
SHORT = 4
#: The most bits of a sketch.
SKETCH = 1 << 16
#: Shingles in buckets of more documents than this, and of EVEN times the mean bucket, are not walked by one task.
HOT, EVEN = 1000, 16
#: Nodes of one side of a comparison unit, and nodes that are compared with a list's least node in one.
BLOCK, STAR = 128, 64
#: The most pairs that a unit gives for each of its nodes; with more, it gives each node's nearest one, and what is then still apart meets as a whole.
DENSE = 1
#: Rows of postings and bytes of texts that are dealt out at once if they are more, but SLICES times at most, so that shuffle files are a part of the table only.
SLICE_ROWS, SLICE_BYTES, SLICES = 1 << 25, 1 << 28, 8
#: Rounds in which each node's text moves for one pair.
ROUNDS = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(h: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` word hashes; of the whole sequence if there are fewer."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n, k = len(h), min(size, len(h))
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : n - k + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text; words by ASCII white space, A-Z lower-cased."""
    for _, hashes, cuts in hashed_words(texts, True):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield shingle_set(hashes[a:b])


def bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40)) % np.uint64(BUCKETS)


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def sketch(grams: np.ndarray) -> bytes:
    """The parities of the numbers of shingles in n to 2n cells; sets differ in at least as many shingles as their parities do."""
    cells = min(SKETCH, 1 << max(6, (len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """The number of shingles that two sets, told by their sketches, differ in at least."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = 8 * len(a), 8 * len(b)
    while m > n:  # the cells of half as many are two of these
        m //= 2
        x = (x >> m) ^ (x & ((1 << m) - 1))
    while n > m:
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """grams, rarest first."""
    rank = np.minimum(counts[bucket(grams)], 0xFFFF).astype(np.uint64)
    return grams[np.argsort(rank << np.uint64(48) | grams >> np.uint64(16))]


class Similarity:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int = 75):
        self.percent = percent

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of sets of a and b members that are linked."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def lengths(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def may_link(self, a: int, x: bytes, b: int, y: bytes) -> bool:
        """Whether sets of a and b members with sketches x and y can be linked."""
        return self.lengths(a, b) and differ(x, y) <= self.room(a, b)

    def room(self, a: int, b: int) -> int:
        """The most shingles that linked sets of a and b members differ in."""
        return a + b - 2 * self.overlap(a, b)


class Node:
    """A set in rank order, with what the filters look at."""

    __slots__ = ("place", "n", "node", "order", "prefix", "set")

    def __init__(self, node: int, order: np.ndarray, prefix: int):
        self.node, self.order, self.n = node, order.tolist(), len(order)
        self.prefix = self.order[:prefix]
        self.place = {g: i for i, g in enumerate(self.prefix)}
        self.set = frozenset(self.order)


def linked(a: Node, b: Node, sim: Similarity) -> bool:
    """The length filter, the positional filter at the first shared prefix shingle, the suffix filter, then the sets."""
    if not sim.lengths(a.n, b.n):
        return False
    need, place = sim.overlap(a.n, b.n), a.place
    for j, g in enumerate(b.prefix):
        if (i := place.get(g)) is not None:
            break
    else:
        return False  # the prefix filter
    if 1 + min(a.n - i - 1, b.n - j - 1) < need:
        return False
    if not _suffixes(a, i + 1, b, j + 1, need - 1):
        return False
    return len(a.set & b.set) >= need


def _suffixes(a: Node, i: int, b: Node, j: int, need: int) -> bool:
    """Splits what follows the shared shingle at b's middle one: what one side has more of cannot be shared."""
    if need <= 0 or j >= b.n:
        return True
    mid = (j + b.n) // 2
    at = a.order.index(b.order[mid]) if b.order[mid] in a.set else None
    if at is None or at < i:
        return True
    return min(at - i, mid - j) + 1 + min(a.n - at - 1, b.n - mid - 1) >= need


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first_pass(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, key), two kinds of rows: (doc_id, key, n, node, sketch) of documents; (block, counts) of shingles by bucket, from each task."""
    names = ["doc_id", "key", "n", "node", "sketch", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n, nodes, sketches, sets = [], [], [], [np.zeros(0, np.uint64)]
            for grams in shingle_sets(batch.column(1)):
                n.append(len(grams))
                nodes.append(node_of(grams) if len(grams) else None)
                sketches.append(sketch(grams) if len(grams) else None)
                sets.append(grams)
            counts += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS)
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        parts = counts.reshape(16, -1)
        kept = [k for k in range(16) if parts[k].any()]
        size = len(kept)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(size, pa.int64())] * 4, pa.nulls(size, pa.binary()), pa.array(kept, pa.int32()), pa.array([parts[k].astype("<i4").tobytes() for k in kept], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, key long, n long, node long, sketch binary, block int, counts binary")


def _sum_counts(blocks: DataFrame) -> np.ndarray:
    """Adds up the blocks of all tasks; the sums have a fixed size, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_py(), "<i4").astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((16, BUCKETS // 16), np.int64)
    for r in blocks.repartition(16, "block").mapInArrow(add, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, "<i8")
    return np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def _postings(docs: DataFrame, counts, sim: Similarity) -> DataFrame:
    """(gram, node, hot) for the prefix of every text; hot: the shingle's bucket is far above others."""
    hot = max(HOT, EVEN * float(counts.value.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = set()
        for batch in batches:
            grams, nodes = [], []
            for g in shingle_sets(batch.column(0)):
                if not len(g) or (node := node_of(g)) in recent:
                    continue
                recent.add(node)
                first = ranked(g, counts.value)[: sim.prefix(len(g))]
                grams.append(first)
                nodes.append(np.full(len(first), node, np.int64))
            if len(recent) > 200_000:
                recent.clear()
            if grams:
                gram = np.concatenate(grams)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(gram)), pa.array(np.concatenate(nodes)), pa.array(counts.value[bucket(gram)] > hot)], ["gram", "node", "hot"])

    return docs.select("text").mapInArrow(run, "gram long, node long, hot boolean")


def _shared(postings: DataFrame) -> DataFrame:
    """(a, b, long), a < b, of shingles with two nodes or more, by one sorted walk that holds at most SHORT rows of a list; postings are of lists of bounded length.

    A short list gives all its pairs; a long one pairs its first node with each other one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long: tuple[int, int, int] | None = None  # a list that goes on: its shingle, first and last node

        def flush(g: np.ndarray, v: np.ndarray, ends: bool):
            """Whole lists of (g, v); what may go on is kept back."""
            nonlocal held_g, held_v, long
            out: list[tuple] = []
            if len(g):
                keep = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
                g, v = g[keep], v[keep]
            if long is not None and len(g):
                same = int(np.searchsorted(g, long[0], side="right"))
                on = v[:same][v[:same] != long[2]]
                out.append((np.full(len(on), long[1]), on, True))
                long = (long[0], long[1], int(v[same - 1])) if same else long
                g, v = g[same:], v[same:]
                long = long if not len(g) else None
            if len(g):
                start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                end = np.append(start[1:], len(g))
                if not ends:
                    s = start[-1]
                    if len(g) - s > SHORT:
                        long = (int(g[s]), int(v[s]), int(v[-1]))
                        out.append((np.full(len(g) - s - 1, v[s]), v[s + 1 :], True))
                        held_g, held_v = g[:0], v[:0]
                    else:
                        held_g, held_v = g[s:], v[s:]
                    start, end = start[:-1], end[:-1]
                else:
                    held_g, held_v = g[:0], v[:0]
                size = end - start
                for m in np.unique(size[(size > 1) & (size <= SHORT)]).tolist():
                    lists = v[start[size == m][:, None] + np.arange(m)]
                    i, j = np.triu_indices(m, 1)
                    out.append((lists[:, i].ravel(), lists[:, j].ravel(), False))
                of = size > SHORT
                if of.any():
                    at = np.concatenate([np.arange(x + 1, y) for x, y in zip(start[of].tolist(), end[of].tolist(), strict=True)])
                    out.append((np.repeat(v[start[of]], size[of] - 1), v[at], True))
            for a, b, is_long in out:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), is_long))], ["a", "b", "long"])

        for batch in batches:
            if batch.num_rows:
                g, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                yield from flush(np.concatenate([held_g, g]), np.concatenate([held_v, v]), False)
        yield from flush(held_g, held_v, True)

    spread = postings.repartition("gram").sortWithinPartitions("gram", "node")
    return spread.mapInArrow(run, "a long, b long, long boolean")


def _stars(postings: DataFrame) -> DataFrame:
    """(a, b, long) of lists of any length: a is the least node, b each other one."""
    least = postings.groupBy(F.col("gram").alias("_g")).agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a != _z").drop("_z")
    least = written(least, "jaccard-heads")  # so that both sides of the join are plain exchanges, which can be split where a shingle is hot
    pairs = postings.join(least, F.col("gram") == F.col("_g")).where("node != a").select("gram", "a", F.col("node").alias("b")).distinct()
    return pairs.select("a", "b", F.lit(True).alias("long"))


def _alike(edges: DataFrame, sizes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b, na, nb) that can still be linked: by their lengths, and by how many prefix shingles they share.

    edges: a, b, c lists, l of them long. Shingles outside both prefixes are
    at most the rest of the longer rest; those in long lists that a third node
    leads are at most as many as either has there.
    """
    led = edges.where("l > 0").groupBy(F.col("b").alias("_of")).agg(F.sum("l").alias("h"))
    info = sizes.join(led, F.col("node") == F.col("_of"), "left").select("node", "n", F.coalesce("h", F.lit(0)).alias("h"))
    shared = edges
    for side in "ab":
        shared = shared.join(info.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("h").alias(f"h{side}")), side)
    p = sim.percent
    need = F.ceil(p * (F.col("na") + F.col("nb")) / (100 + p))
    rest = F.ceil(p * F.greatest("na", "nb") / 100) - 1
    lengths = 100 * F.least("na", "nb") >= p * F.greatest("na", "nb")
    return shared.where(lengths & (F.col("c") + F.least("ha", "hb") + rest >= need)).select("a", "b", "na", "nb")


def _sketches(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, sketch) of the chosen (node, _key)."""
    found = members.join(chosen.select("_key"), F.col("key") == F.col("_key")).select("node", "n", "sketch")
    return found.dropDuplicates(["node"])


def _near(pairs: DataFrame, sketches: DataFrame, sim: Similarity) -> DataFrame:
    """Of pairs (a, b, na, nb), those (a, b) that their sketches don't tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("na", "sa", "nb", "sb")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([sim.may_link(*r) for r in rows], pa.bool_()))

    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}")), side)
    return pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, size, text): the compressed text of one document, or of a few, of each chosen (node, _key).

    No text is shuffled: a filter of the keys tells which documents are taken,
    and their nodes are made again. What it takes besides has the node of its
    own text, so it is a copy or is not asked for.
    """
    keys = written(chosen.select(F.col("_key").alias("hash")), "jaccard-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, codec = set(), pa.Codec("zstd", 1)
        for batch in batches:
            nodes, sizes, texts = [], [], []
            for grams, text in zip(shingle_sets(batch.column(0)), batch.column(0), strict=True):
                if len(grams) and (node := node_of(grams)) not in recent:
                    recent.add(node)
                    data = text.as_buffer()
                    nodes.append(node)
                    sizes.append(data.size)
                    texts.append(codec.compress(data, asbytes=True))
            if len(recent) > 200_000:
                recent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["node", "size", "text"])

    found = docs.where(bloom(keys, keys.count())(F.col("key"))).select("text")
    found = written(found.mapInArrow(run, "node long, size long, text binary"), "jaccard-texts")
    discard(keys)
    return found


def _units(units: DataFrame, run, schema: str) -> DataFrame:
    """Runs over the rows of one unit after the other, each whole in one task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for u, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    if len(rows) > 1:
                        yield run(unit, rows)
                    unit, rows = u, []
                rows.append(row)
        if len(rows) > 1:
            yield run(unit, rows)
        give_back()

    return units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(walk, schema)


def _sides(rows: list) -> tuple[list, list | None]:
    """The two sides of a unit, each node once; no right one if the left is compared with itself. rows: side, node and others."""
    made = {r[1]: r for r in rows}
    left = sorted((r for r in made.values() if r[0] != 1), key=lambda r: r[1])
    right = [r for r in made.values() if r[0] == 1]
    return left, right or None


def _screen(units: DataFrame, sketches: DataFrame, sim: Similarity) -> DataFrame:
    """What can be linked between the two sides of each unit, by sizes and sketches: (unit, side, node) of their nodes, and pairs (node, other) with how far they are apart. units: as for _compare.

    A unit with more than DENSE pairs for each node (dense) gives each node's
    nearest one only, so rows stay in proportion to nodes.
    """
    names = ["unit", "side", "node", "other", "far", "dense"]

    def run(unit: int, rows: list) -> pa.RecordBatch:
        left, right = _sides(rows)
        pairs, nearest, n = {}, {}, 0
        most = DENSE * (len(left) + len(right or []))
        for i, (_, a, ca, na, sa) in enumerate(left):
            for _, b, cb, nb, sb in right if right is not None else left[:i]:
                if ca == cb or not sim.lengths(na, nb) or (d := differ(sa, sb)) > (room := sim.room(na, nb)):
                    continue
                n, far = n + 1, d / max(room, 1)
                if n <= most:
                    pairs[a, b] = far
                for x, y in ((a, b), (b, a)):
                    if x not in nearest or (far, y) < nearest[x]:
                        nearest[x] = (far, y)
        if dense := n > most:
            pairs = {(min(x, y), max(x, y)): far for x, (far, y) in nearest.items()}
        out = [(unit, side, node, None, None, dense) for side, node, *_ in [*left, *(right or [])] if node in nearest]
        out += [(unit, None, a, b, far, dense) for (a, b), far in pairs.items()]
        columns = zip(*out, strict=True) if out else ((),) * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return _units(units.join(sketches, "node").select("unit", "side", "node", "comp", "n", "sketch"), run, "unit long, side int, node long, other long, far double, dense boolean")


def _compare(units: DataFrame, texts: DataFrame, counts, sim: Similarity) -> DataFrame:
    """Links (a, b) between the two sides of each unit, found by one task that holds at most two blocks of texts.

    units: unit, side (0 or 1; 2 is side 0 compared with itself), node, comp. Nodes of one component are not compared.
    """

    def run(unit: int, rows: list) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        def made(side: list | None) -> list | None:
            if side is None:
                return None
            codec = pa.Codec("zstd")
            whole = pa.array([codec.decompress(text, size, asbytes=True) for *_, size, text in side], pa.large_binary())
            out = []
            for (_, node, comp, _, _), grams in zip(side, shingle_sets(whole), strict=True):
                out.append((Node(node, ranked(grams, counts.value), sim.prefix(len(grams))), comp))
            return out

        left, right = map(made, _sides(rows))
        out = []
        for i, (a, ca) in enumerate(left):
            for b, cb in right if right is not None else left[:i]:
                ra, rb = root(ca), root(cb)
                if ra != rb and linked(a, b, sim):
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((a.node, b.node))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _units(units.join(texts, "node").select("unit", "side", "node", "comp", "size", "text"), run, "a long, b long")


def _in_slices(units: DataFrame, rows: int, texts: DataFrame, counts, sim: Similarity, name: str) -> DataFrame:
    """The links of _compare as a table; where units have many rows, a part of the units and of the texts moves at a time."""
    size = texts.agg(F.avg("size")).first()[0] or 0
    slices = max(1, min(SLICES, math.ceil(rows * size / SLICE_BYTES)))
    if slices == 1:
        return written(_compare(units, texts, counts, sim), name)
    out = None
    for k in range(slices):
        some = written(units.where(F.pmod("unit", F.lit(slices)) == k), "jaccard-slice")
        near = texts.where(bloom(some.select(F.col("node").alias("hash")), some.count())(F.col("node")))
        part = written(_compare(some, near, counts, sim), name)
        discard(some)
        out = part if out is None else out.unionByName(part)
    return out


def _star_units(pairs: DataFrame) -> DataFrame:
    """Units of (a, b, a_comp, b_comp): each first node against its others, STAR of them at a time."""
    big = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / STAR).alias("_blocks"))
    sides = pairs.join(big, F.col("a") == F.col("_a")).withColumn("unit", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_blocks"))))
    heads = sides.select("unit", F.lit(0).alias("side"), F.col("a").alias("node"), F.col("a_comp").alias("comp")).distinct()
    return heads.unionByName(sides.select("unit", F.lit(1).alias("side"), F.col("b").alias("node"), F.col("b_comp").alias("comp")))


def _with_comps(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """pairs with the component of either side, which is itself if it has no link."""
    for c in "ab":
        of = comps.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        pairs = pairs.join(of, F.col(c) == F.col("_n"), "left").withColumn(f"{c}_comp", F.coalesce("_l", c)).drop("_n", "_l")
    return pairs


def _in_rounds(pairs: DataFrame, links: DataFrame | None, comps: DataFrame | None, texts: DataFrame, counts, sim: Similarity, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links with those that pairs (a, b) add between different components, the components, and the pairs that did not meet.

    In a round each node meets the one of most pairs among its others, so a
    text moves once in it, and pairs within a component then need no more.
    whole: what is apart after the rounds meets at once, pair by pair.
    """
    for last in [False] * ROUNDS + [True] * whole:
        if comps is None:
            apart = pairs.withColumns({"a_comp": F.col("a"), "b_comp": F.col("b")})
        else:
            apart = _with_comps(pairs, comps).where("a_comp != b_comp")
        apart = written(apart, "jaccard-apart")
        if comps is not None and not apart.take(1):
            pairs = apart.select("a", "b")
            break
        degree = apart.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
        turned = apart
        for c in "ab":
            turned = turned.join(degree.select(F.col("node").alias(c), F.col("d").alias(f"d{c}")), c)
        first = F.struct(F.col("da").alias("d"), F.col("a").alias("node"), F.col("a_comp").alias("comp"))
        second = F.struct(F.col("db").alias("d"), F.col("b").alias("node"), F.col("b_comp").alias("comp"))
        turned = written(turned.select(F.greatest(first, second).alias("x"), F.least(first, second).alias("y")), "jaccard-turned")
        discard(apart)
        met = turned if last else turned.groupBy("y").agg(F.max("x").alias("x"))
        met = written(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("a_comp"), F.col("y.comp").alias("b_comp")), "jaccard-met")
        more = _in_slices(_star_units(met), 2 * met.count(), texts, counts, sim, "jaccard-links")
        links = more if links is None else links.unionByName(more)
        comps = components(links, "jaccard-stars", spread=False)
        pairs = turned.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).join(met.select("a", "b"), ["a", "b"], "left_anti")
    return links, comps, pairs


def components(links: DataFrame, name: str = "components", spread: bool = True) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the least node that is reachable.

    Each round points every node to its least neighbour and contracts the
    links. With `spread`, nodes are numbered by a hash that no two share
    meanwhile, so ids that follow each other make no long chains: rounds are
    about the logarithm of the nodes. Without it, for nodes that are hashes
    already, the label is any node of the component. Every table is written,
    aggregates combine before the shuffle, and nothing is collected.
    """
    links = links.where("a != b")
    if spread:
        links = links.select("a", "b", F.xxhash64("a").alias("_ha"), F.xxhash64("b").alias("_hb"))
        names = written(links.select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("_ha").alias("_n")), F.struct(F.col("b").alias("name"), F.col("_hb").alias("_n")))).alias("x")).select("x.*").distinct(), f"{name}-names")
        links = links.select(F.col("_ha").alias("a"), F.col("_hb").alias("b"))
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    labels = written(labels, f"{name}-labels")
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("_of")).agg(F.min("b").alias("_near")).select("_of", F.least("_of", "_near").alias("_to"))
        to = written(to, f"{name}-step")
        last, old = labels, links
        labels = written(labels.join(to, labels["label"] == to["_of"], "left").select("node", F.coalesce("_to", "label").alias("label")), f"{name}-labels")
        one, two = to.withColumnsRenamed({"_of": "_a", "_to": "_pa"}), to.withColumnsRenamed({"_of": "_b", "_to": "_pb"})
        moved = links.join(one, links["a"] == one["_a"]).join(two, links["b"] == two["_b"]).where("_pa != _pb")
        links = written(moved.select(F.greatest("_pa", "_pb").alias("a"), F.least("_pa", "_pb").alias("b")).distinct(), f"{name}-links")
        discard(last, old, to)
    if not spread:
        return labels
    named = labels.join(names, F.col("node") == F.col("_n")).select("name", "label")
    least = named.groupBy(F.col("label").alias("_l")).agg(F.min("name").alias("least"))
    return written(named.join(least, F.col("label") == F.col("_l")).select(F.col("name").alias("node"), F.col("least").alias("label")), f"{name}-named")


def _row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows of one id (null or not) and text only."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def _classes(df: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node, label) of every row: label is a node of its component, null for rows without words; and the verified links (a, b) of nodes."""
    spark: SparkSession = df.sparkSession
    bounded_batches(spark)
    sim = Similarity(percent)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("key"))
    first = written(_first_pass(docs), "jaccard-first")
    members = first.where("n is not null").select("doc_id", "key", "n", "node", "sketch")
    counts = spark.sparkContext.broadcast(_sum_counts(first.where("block is not null").select("block", "counts")))

    postings = written(_postings(docs, counts, sim), "jaccard-postings")
    found = written(_stars(postings.where("hot").select("gram", "node")), "jaccard-hot")
    slices = max(1, min(SLICES, math.ceil(postings.count() / SLICE_ROWS)))
    for k in range(slices):
        cold = postings.where("not hot").where(F.pmod("gram", F.lit(slices)) == k).select("gram", "node")
        found = found.unionByName(written(_shared(cold), "jaccard-lists"))
    discard(postings)
    edges = written(found.groupBy("a", "b").agg(F.count("*").alias("c"), F.sum(F.col("long").cast("long")).alias("l")), "jaccard-edges")
    discard(found)
    sizes = members.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("key").alias("key"))

    def chosen(nodes: DataFrame) -> DataFrame:
        """(node, _key) of one document of each node."""
        return sizes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("key").alias("_key"))

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    alike = written(_alike(edges, sizes.select("node", "n"), sim), "jaccard-alike")
    sketches = written(_sketches(members, chosen(ends(alike))), "jaccard-sketches")
    near = written(_near(alike, sketches, sim), "jaccard-near")
    discard(alike, sketches)
    texts = _texts(docs, chosen(ends(near)))

    links, comps, _ = _in_rounds(near, None, None, texts, counts, sim, True)
    discard(texts, near)

    # First nodes of long lists that still hold more than one component: their nodes meet again in blocks, but never two of the largest component.
    told = written(_with_comps(edges.where("l > 0").select("a", "b"), comps), "jaccard-told")
    mixed = told.where("a_comp != b_comp").select("a").distinct()
    left = told.join(mixed, "a", "left_semi")
    inside = left.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("b_comp").alias("comp")).unionByName(left.select(F.col("a").alias("leader"), F.col("a").alias("node"), F.col("a_comp").alias("comp"))).distinct()
    inside = written(inside, "jaccard-inside")
    discard(edges, told)
    sketches = written(_sketches(members, chosen(inside.select("node"))), "jaccard-sketches")
    shape = inside.groupBy("leader", "comp").count().groupBy("leader").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n_all"))
    blocks = inside.join(shape, "leader").withColumn("is_main", F.col("comp") == F.col("main"))
    n_main = F.ceil(F.col("n_main") / BLOCK).cast("int")
    n_rest = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
    spread = F.xxhash64("node")
    blocks = blocks.withColumn("n_m", n_main).withColumn("n_r", n_rest).withColumn("own", F.when(F.col("is_main"), F.pmod(spread, F.col("n_m"))).otherwise(F.pmod(spread, F.greatest("n_r", F.lit(1)))).cast("int"))
    # A unit is (leader, block of the rest, kind, other block): rest with main, rest with another rest block, rest with itself.
    pairs = F.when(
        F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("n_r") - 1), lambda r: F.struct(r.alias("r"), F.lit("m").alias("kind"), F.col("own").alias("o"), F.lit(1).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("n_m") - 1), lambda m: F.struct(F.col("own").alias("r"), F.lit("m").alias("kind"), m.alias("o"), F.lit(0).alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("n_r") - 1), lambda o: F.struct(F.least("own", o).alias("r"), F.when(o == F.col("own"), "s").otherwise("r").alias("kind"), F.greatest("own", o).alias("o"), F.when(F.col("own") > o, 1).otherwise(0).alias("side"))),
        )
    )
    again = blocks.where("n_r > 0").select("leader", "node", "comp", F.explode(pairs).alias("p"))
    again = again.select(F.xxhash64("leader", "p.r", "p.kind", "p.o").alias("unit"), F.col("p.side").alias("side"), "node", "comp")
    again = written(_screen(again, sketches, sim), "jaccard-units")
    pairs = again.where("other is not null").groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.min("far").alias("far"))
    pairs = written(pairs, "jaccard-pairs")
    nodes = again.where("other is null")
    texts = _texts(docs, chosen(nodes.select("node")))
    # Each node meets its nearest one over all units first; these pairs are no more than the nodes.
    sides = pairs.select("a", "b", "far", F.explode(F.array("a", "b")).alias("node"))
    nearest = sides.groupBy("node").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("p")).select("p.*").distinct()
    nearest = written(nearest, "jaccard-nearest")
    links, comps, _ = _in_rounds(nearest, links, comps, texts, counts, sim, True)
    # What did not meet yet meets unit by unit where it can still join components; of dense units, not all pairs are known.
    apart = _with_comps(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), comps).where("a_comp != b_comp")
    now = lambda df: df.join(comps.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"), "left").select("unit", "side", "node", F.coalesce("label", "node").alias("comp"))
    mixed = lambda df: df.join(df.groupBy(F.col("unit").alias("_u")).agg(F.min("comp").alias("_least"), F.max("comp").alias("_most")).where("_least != _most"), F.col("unit") == F.col("_u"), "left_semi")
    dense = written(now(nodes.where("dense").select("unit", "side", "node")), "jaccard-dense")
    dense = written(_screen(mixed(dense), sketches, sim).where("other is null").select("unit", "side", "node"), "jaccard-dense")
    open_ = written(now(nodes.where("not dense").select("unit", "side", "node").join(ends(apart).distinct(), "node", "left_semi").unionByName(dense)), "jaccard-open")
    links = links.unionByName(_in_slices(mixed(open_), open_.count(), texts, counts, sim, "jaccard-more"))
    labels = components(links, "jaccard-all", spread=False)
    discard(texts, sketches, again, inside, pairs)
    labels = labels.withColumnRenamed("node", "_node")
    marked = members.join(labels, F.col("node") == F.col("_node"), "left")
    return marked.select("doc_id", "key", "n", "node", F.coalesce("label", "node").alias("label")), links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id (the least id reachable by links, its own included).

    Null and empty texts and texts without words have no shingles and are
    linked with nothing; a text of fewer than five words is one shingle; equal
    rows each get their row. Rows with a null id take part, but a component is
    named by its least id that is not null (null if it has none). Shingles and
    sets are told apart by 64-bit hashes. Other columns are not looked at. An
    empty table stays empty.
    """
    marked = written(_classes(df, id_col, text_col, percent)[0], "jaccard-marked")
    best = marked.where("label is not null").groupBy(F.col("label").alias("_c")).agg(F.min("doc_id").alias("_least"))
    best = written(best, "jaccard-least")  # so that both sides of the join are plain exchanges, which can be split where a component is hot
    named = marked.join(best, F.col("label") == F.col("_c"), "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def representative_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Verified links between different shingle sets as (least id of the one, least id of the other), least first.

    They join each component as a whole, so with component_id of
    near_duplicates, which is the membership, no document is lost. Copies are
    represented by their least id (null if they have none), and of a group of
    near copies not all pairs are listed, as their number is the square of its
    size.
    """
    marked, links = _classes(df, id_col, text_col, percent)
    names = written(marked.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id")), "jaccard-names")
    for side in "ab":
        links = links.join(names.select(F.col("node").alias(side), F.col("id").alias(f"id_{side}")), side)
    return links.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """df with one row of each group of near duplicates; columns stay as they are.

    That of the least id stays; null ids come last, and among rows of one id
    that of the least hash of its text stays, once if it repeats. Rows without
    words (null and empty texts too) are in no group and all stay.
    """
    found = written(_classes(df, id_col, text_col, percent)[0].where("label is not null").select("label", "doc_id", "key"), "jaccard-found")
    # The least id, then the least key of that id: plain numbers, which combine before the shuffle.
    ids = found.groupBy("label").agg(F.min("doc_id").alias("_id")).withColumnRenamed("label", "_l")
    ids = written(ids, "jaccard-least")
    first = found.join(ids, (F.col("label") == F.col("_l")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    kept = written(first.groupBy("label").agg(F.min("key").alias("_kept")).select("_kept"), "jaccard-kept")
    may = bloom(kept.select(F.col("_kept").alias("hash")), kept.count())  # before whole rows are shuffled
    key = free_name(df, "_key")
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = df.where(words).withColumn(key, _row_key(id_col, text_col)).where(may(F.col(key))).join(kept, F.col(key) == F.col("_kept"), "left_semi")
    return one.dropDuplicates([key]).drop(key).unionByName(df.where(~words))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[k : k + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.rid < y.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(rid, other) AS (SELECT rid, rid FROM d UNION SELECT c.rid, e.b FROM c JOIN e ON c.other = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM c JOIN d ON d.rid = c.rid JOIN d o ON o.rid = c.other LEFT JOIN n ON n.rid = c.rid GROUP BY d.rid, d.doc_id
"""
