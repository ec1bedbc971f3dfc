"""Best-fit packing of token pieces into sequences by bin completion.

Pieces of one length are interchangeable, so the search runs on the histogram
of lengths, which has at most `capacity` entries at any input size. The plan
says which lengths share a sequence and how often; rows then find their place
by their rank among the rows of their length.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryweb.llm.common import bounded_batches, free_name, table, whole_text, written
from quarryweb.llm.tokens import token_ids

CAPACITY = 2048
#: Rows of one length that one task ranks, about.
RANKED_TOGETHER = 4096

#: Steps of an enumeration that count as a bin that is tried.
STEPS = 32

Pattern = tuple[tuple[int, ...], int]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: items over half need their own bins, and the rest must fit around them."""
    size = np.array(sorted(hist), dtype=np.int64)
    count = np.array([hist[x] for x in size.tolist()], dtype=np.int64)
    best = math.ceil(int((size * count).sum()) / capacity)
    for p in {0, *(x for x in size.tolist() if 2 * x <= capacity)}:
        huge, big, small = size > capacity - p, (size <= capacity - p) & (2 * size > capacity), (2 * size <= capacity) & (size >= p)
        free = int((count[big] * (capacity - size[big])).sum())
        best = max(best, int(count[huge].sum() + count[big].sum()) + max(0, math.ceil((int((size[small] * count[small]).sum()) - free) / capacity)))
    return best


def best_fit(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing over whole groups of equal pieces: the first incumbent."""
    groups: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in groups:
            rooms.insert(bisect_left(rooms, room), room)
        groups.setdefault(room, []).append((pattern, n))

    for x in sorted(hist, reverse=True):
        n = hist[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                each = capacity // x
                for k, m in ((each, n // each), (n % each, 1)):
                    if k and m:
                        put(capacity - k * x, (x,) * k, m)
                break
            room = rooms[at]
            pattern, m = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            if m > n:
                put(room, pattern, m - n)
                m = n
            put(room - x, (*pattern, x), m)
            n -= m
    return [p for room in groups.values() for p in room]


@dataclass(frozen=True)
class Effort:
    """Bounds of the search; they cost bins, never pieces: the incumbent is always whole.

    work: bins tried in all, where STEPS of enumeration count as one more, and
    first, the share of it for dives over all pieces. width: fillings kept of
    those found for a bin; steps: steps of their enumeration, which also ends
    at `width` that fill the bin exactly. discrepancies: how far a dive may
    leave the first choices. group, work_each: bins emptied together in a
    repair, and work there.
    """

    work: int = 400_000
    first: float = 0.125
    width: int = 8
    steps: int = 400
    discrepancies: int = 3
    group: int = 14
    work_each: int = 1000


class _Left:
    """Pieces that are not packed: counts by size, and the sizes in order."""

    def __init__(self, hist: dict[int, int]):
        self.count = {x: n for x, n in hist.items() if n}
        self.sizes = sorted(self.count)
        self.total = sum(x * n for x, n in self.count.items())
        self.steps = 0

    def take(self, pattern: tuple[int, ...], m: int) -> None:
        for x in pattern:
            self.count[x] -= m
        for x in set(pattern):
            if not self.count[x]:
                del self.sizes[bisect_left(self.sizes, x)]
        self.total -= m * sum(pattern)

    def put(self, pattern: tuple[int, ...], m: int) -> None:
        for x in set(pattern):
            if not self.count[x]:
                self.sizes.insert(bisect_left(self.sizes, x), x)
        for x in pattern:
            self.count[x] += m
        self.total += m * sum(pattern)


def fillings(left: _Left, largest: int, capacity: int, waste: int, effort: Effort = Effort()) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated ways (waste, pieces) to fill the bin of the largest piece with at most so much waste: least waste first, then the most plentiful pieces.

    A piece of exactly the space that remains dominates every other completion
    of that space; fillings that leave room for another piece, or in which a
    piece can be swapped for a larger one that still fits, are dominated too.
    """
    count, sizes = left.count, left.sizes
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = exact = 0
    have = lambda x: count.get(x, 0) - (x == largest)

    def walk(space: int, k: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps, exact
        steps += 1
        k = min(k, bisect_right(sizes, space) - 1)
        if k >= 0 and sizes[k] == space and have(space) > 0:
            found.append((0, (*chosen, space)))
            exact += 1
            return
        grown = False
        while k >= 0:
            x = sizes[k]
            for c in range(min(have(x), space // x), 0, -1):
                grown = True
                rest = space - c * x
                if rest == 0:
                    exact += 1
                if rest < sizes[0]:
                    found.append((rest, chosen + (x,) * c))
                else:
                    walk(rest, k - 1, chosen + (x,) * c)
                if steps > effort.steps or exact >= effort.width:
                    return
            if grown and space - x < sizes[0]:  # smaller pieces that also end the bin are dominated
                k = min(k, bisect_right(sizes, space - sizes[0]))
            k -= 1
        if not grown:
            found.append((space, chosen))

    walk(capacity - largest, len(sizes) - 1, ())
    left.steps += steps + len(found)
    swap = lambda x, w, f: any(sizes[k] not in f and have(sizes[k]) > 0 for k in range(bisect_right(sizes, x), bisect_right(sizes, x + w)))
    out: list[tuple[int, tuple[int, ...]]] = []
    for w, f in sorted({f for f in found if f[0] <= waste}, key=lambda f: (f[0], -min((count[y] for y in f[1]), default=0), len(f[1]), tuple(-y for y in f[1]))):
        if out and w and any(swap(x, w, f) for x in set(f)):
            continue
        out.append((w, f))
        if len(out) == effort.width:
            break
    return out


def search(hist: dict[int, int], capacity: int, bins: int, waste: int, work: int, effort: Effort = Effort()) -> tuple[list[Pattern] | None, int]:
    """(the packing into at most `bins` bins of least waste outside its emptiest bin, if that is below `waste`; work done).

    Bins are completed around the largest piece that is left; a filling is
    used as often as its pieces allow, or once. Dives follow the first choice
    but for 0, 1, 2, ... discrepancies in all, so early choices are revisited
    before late ones are exhausted. A branch is cut once its waste reaches the
    incumbent's.
    """
    best, done = None, 0
    for most in range(effort.discrepancies + 1):
        left = _Left(hist)
        path: list[tuple[tuple[int, ...], int, int]] = []
        lost = used = 0

        def options() -> list[tuple[tuple[int, ...], int, int]]:
            x, out = left.sizes[-1], []  # noqa: B023
            for w, f in fillings(left, x, capacity, waste - 1 - lost, effort):  # noqa: B023
                pattern = (x, *f)
                m = min(left.count[y] // pattern.count(y) for y in set(pattern))  # noqa: B023
                if w:
                    m = min(m, max(1, (waste - 1 - lost) // w))  # noqa: B023
                out.append((pattern, m, w))
                if m > 1:
                    out.append((pattern, 1, w))
            return out

        stack = [[options(), 0, most]] if left.sizes else []
        while stack:
            if len(path) == len(stack):  # back here: take the last filling out
                pattern, m, w = path.pop()
                left.put(pattern, m)
                lost, used = lost - w * m, used - m
            choices, i, more = stack[-1]
            if i >= len(choices) or i > more:
                stack.pop()
                continue
            stack[-1][1] += 1
            pattern, m, w = choices[i]
            done += 1
            if done + left.steps // STEPS > work:
                return best, done + left.steps // STEPS
            if lost + w * m >= waste or used + m + (left.total > m * sum(pattern)) > bins:
                continue
            left.take(pattern, m)
            path.append((pattern, m, w))
            lost, used = lost + w * m, used + m
            if left.total <= capacity:
                rest = tuple(x for x in reversed(left.sizes) for _ in range(left.count[x]))
                best, waste = [(p, n) for p, n, _ in path] + ([(rest, 1)] if rest else []), lost
                if not waste:
                    return best, done + left.steps // STEPS
                stack.append([[], 0, 0])
            else:
                stack.append([options(), 0, more - i])
        done += left.steps // STEPS
    return best, done


def complete(hist: dict[int, int], capacity: int = CAPACITY, effort: Effort = Effort()) -> list[Pattern]:
    """Bin completion, with best fit as the first incumbent and every better packing as the next.

    First over all pieces, then, as long as there is work left, over the pieces of a
    few bins that are emptied together: the emptiest one, others with waste and
    some full ones, each as often as the rarest of them stands in the packing.
    The search ends at the lower bound or with its effort.
    """
    hist = {int(x): int(n) for x, n in hist.items() if n}
    if not hist:
        return []
    bound = lower_bound(hist, capacity)
    packing: Counter[tuple[int, ...]] = Counter()
    for pattern, n in best_fit(hist, capacity):
        packing[pattern] += n
    bins = packing.total()
    space = lambda p: capacity - sum(p)
    if bins > bound:
        got, done = search(hist, capacity, bins, sum(space(p) * n for p, n in packing.items()) - max(map(space, packing)), int(effort.work * effort.first), effort)
        if got:
            packing = Counter()
            for pattern, n in got:
                packing[pattern] += n
            bins = packing.total()
        dice = random.Random(0)
        while bins > bound and done < effort.work:
            poor = sorted((p for p in packing if space(p)), key=lambda p: (-space(p), p))
            full = sorted(p for p in packing if not space(p))
            some = min(len(poor), max(1, effort.group * 2 // 3))
            pick = [poor[0], *dice.sample(poor[1:], some - 1)]
            pick += dice.sample(full, min(len(full), effort.group - some))
            times = min(packing[p] for p in pick)
            if len(pick) == 1:  # equal bins with waste only: some of them together
                pick, times = pick * min(effort.group, packing[pick[0]]), max(1, packing[pick[0]] // effort.group)
            emptied = Counter(pick)
            got, n = search(dict(Counter(x for p in pick for x in p)), capacity, len(pick), sum(map(space, pick)) - max(map(space, pick)) + 1, effort.work_each, effort)
            done += max(1, n)
            if got:
                for p, m in emptied.items():
                    packing[p] -= m * times
                for p, m in got:
                    packing[tuple(sorted(p, reverse=True))] += m * times
                packing = +packing
                bins = packing.total()
    return list(packing.items())


def pack(df: DataFrame, length_col: str = "length", capacity: int = CAPACITY, name: str = "pieces") -> DataFrame:
    """df with sequence_id and offset: every row has a place, no sequence is longer than capacity, and there are few of them.

    df is read once and written with a random salt, so equal rows do not meet
    in one task however many there are; rows are told apart by their rank
    only. Lengths must be 1 to capacity; a null or other length raises. An
    empty table stays empty; columns named sequence_id or offset are replaced,
    all others stay. Only the histogram (at most `capacity` rows) reaches the
    driver, and the plan that is broadcast has a few rows for each length.
    """
    spark = df.sparkSession
    df = df.drop("sequence_id", "offset")
    salt = free_name(df, "_salt")
    df = written(df.withColumn(salt, F.floor(F.rand(7) * (1 << 30)).cast("int")), name)
    order = [F.col(f"`{c}`") for c, kind in df.dtypes if c != salt and kind != "binary"]
    length = F.col(length_col)
    hist = {r[0]: r[1] for r in df.groupBy(length.cast("int")).count().collect()}
    if any(x is None or not 1 <= x <= capacity for x in hist):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    slots, taken, first = [], {}, 0
    for pattern, n in complete(hist, capacity):
        at = 0
        for x in pattern:
            begin = taken.get(x, 0)
            slots.append((x, begin, begin + n, first - begin, at))
            taken[x] = begin + n
            at += x
        first += n
    rows = sum(hist.values())
    salts = max(64, 1 << math.ceil(math.log2(max(1, rows / RANKED_TOGETHER))))

    # Ranks within a length: by salted group, plus the sizes of the groups before it. A length that many rows share meets in no task.
    salted = df.withColumn(salt, F.pmod(F.col(salt), F.lit(salts)))
    group = Window.partitionBy(length.cast("int"), salt)
    ranked = salted.withColumn("_rank", F.row_number().over(group.orderBy(*order)) - 1)
    before = salted.groupBy(length.cast("int").alias("_length"), F.col(salt).alias("_of")).count()
    before = before.select("_length", "_of", (F.sum("count").over(Window.partitionBy("_length").orderBy("_of")) - F.col("count")).alias("_before"))
    placed = ranked.join(before, (length.cast("int") == F.col("_length")) & (F.col(salt) == F.col("_of"))).drop("_length", "_of", salt)
    plan = spark.createDataFrame(slots, "_length int, _from long, _to long, _shift long, offset long")
    rank = F.col("_rank") + F.col("_before")
    placed = placed.join(F.broadcast(plan), (length.cast("int") == F.col("_length")) & (rank >= F.col("_from")) & (rank < F.col("_to")))
    return placed.withColumn("sequence_id", rank + F.col("_shift")).drop("_length", "_from", "_to", "_shift", "_rank", "_before")


def pieces(df: DataFrame, ids: Column, capacity: int = CAPACITY) -> DataFrame:
    """df without text: piece, start, length and ids of each piece of at most capacity ids; only longer documents are cut."""
    n = (F.octet_length(F.col("_ids")) / 4).cast("long")
    cut = df.withColumn("_ids", ids).withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))))
    length = F.least(F.lit(capacity).cast("long"), n - F.col("_start"))
    return (
        cut.withColumn("piece", (F.col("_start") / capacity).cast("int"))
        .withColumn("start", F.col("_start"))
        .withColumn("length", length)
        .withColumn("ids", F.expr(f"substring(_ids, cast(_start * 4 + 1 as int), {capacity * 4})"))
        .drop("_ids", "_start")
    )


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, name: str = "pieces", with_ids: bool = False) -> DataFrame:
    """All whole texts as pieces with a place: id_col, piece, start, length, ids_crc32, sequence_id, offset; with_ids: and ids, little-endian unsigned 32-bit.

    Null and empty texts are the end id alone. Ids of documents may be null or
    repeat, and every row has its own pieces. Other columns are not looked at.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cut = pieces(rows, token_ids(F.col("_text"), end_id), capacity).drop("_text")
    cut = cut.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else []))
    return pack(cut, "length", capacity, name)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text")))
