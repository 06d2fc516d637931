"""Size-aware heavy-light join of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Equal sets are one class and need no join. Small sets list subsets of fixed sizes that a linked set must contain
too; larger sets are found by scanning inverted lists of each set's rarest shingles (as many as a linked set can't
avoid). The boundary between small and large is where listing subsets begins to cost more than scanning.

Short lists are opened to pairs. Long ones first hang their sets on one pivot each, which joins most of what belongs
together; lists that still hold sets of different components are then scanned block by block for partners outside a
set's component, and later rounds scan only blocks that have more to propose. A pair must share a number of rare shingles
that depends on both sizes, not just one. Only pairs that a bitmap bound leaves possible are looked at, each of them on
whole sets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import common, shingles
from .components import components

#: Jaccard of at least NUM / DEN.
NUM, DEN = 4, 5
#: Sets that list subsets make so many rows each at most; this alone bounds what cost may choose.
SUBSETS = 8192
#: Counters that order shingles by how common they are; a fixed size, whatever the corpus. Order alone depends on it.
COUNTERS = 1 << 22
#: Longer lists are worked on in blocks.
SHORT, BLOCK = 16, 1024
#: Forests of pairs that a pair of blocks proposes at first; sixteen times as many whenever it is scanned again.
FORESTS = 2
#: Lists that may be longer, by the counters, are dealt over several tasks when it is seen which lists are shared.
IN_ONE_TASK = 1 << 22
#: Rows that Python functions take at once, so that whole sets of few documents are in memory together.
ROWS = 1024
#: Places of the bitmaps, and of those that sets of WIDE_FROM and more have besides.
BITMAP, WIDE, WIDE_FROM = 512, 8192, 600


def least_overlap(n: int) -> int:
    """What any linked set shares with a set of n at least."""
    return -(-NUM * n // DEN)


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1


def pair_overlap(n: int, m: int) -> int:
    """The overlap at which sets of n and m link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def least_shared(n, m):
    """How many keys linked sets of n and m have in common at least, unless both are small.

    Of the two prefixes one ends first in the order of shingles. What is shared up to there lies in both prefixes, and
    beyond it that set has fewer than ``least_overlap`` shingles left.
    """
    return -(-NUM * (n + m) // (NUM + DEN)) + (-NUM * np.maximum(n, m) // DEN) + 1


_LEAST_SHARED = f"((({NUM} * (n + m) + {NUM + DEN - 1}) div {NUM + DEN}) - (({NUM} * greatest(n, m) + {DEN - 1}) div {DEN}) + 1)"


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a small set lists: one for each overlap that a small partner can need."""
    return sorted({pair_overlap(n, m) for m in range(1, boundary + 1) if DEN * min(n, m) >= NUM * max(n, m)})


def subset_rows(n: int, boundary: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, boundary) if c <= n)


def largest_small() -> int:
    """The largest boundary at which no set lists more than SUBSETS subsets."""
    b = 0
    while max(subset_rows(n, b + 1) for n in range(1, b + 2)) <= SUBSETS:
        b += 1
    return b


def bitmap(s: np.ndarray, places: int = BITMAP) -> bytes:
    """Parity of the shingles in each place: two sets differ in as many places at most as in shingles."""
    return np.packbits(np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, d1, d2 (the set's digest), bits, wide (for large sets); for sets that may be small also the shingles themselves."""
    most = largest_small()

    def run(batches):
        for b in common.slices(batches, ROWS, "shingles", shingles.forget):
            n, d1, d2, bits, wide, small = [], [], [], [], [], []
            for s in shingles.sets_of(b.column(1).to_pylist()):
                x, y = shingles.digest(s)
                n.append(len(s))
                d1.append(x)
                d2.append(y)
                bits.append(bitmap(s))
                wide.append(bitmap(s, WIDE) if len(s) >= WIDE_FROM else None)
                small.append(_signed(s).tolist() if 0 < len(s) <= most else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(small, pa.list_(pa.int64()))], ["id", "n", "d1", "d2", "bits", "wide", "small"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n int, d1 bigint, d2 bigint, bits binary, wide binary, small array<bigint>")


def commonness(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """For each counter a class, higher for shingles in more documents, and the tasks that its lists are dealt over.

    Counted over all documents. A counter is at least as high as the length of any list of its shingles.
    """

    def counts(batches):
        v = np.zeros(COUNTERS, np.int64)
        for b in common.slices(batches, ROWS, "shingles", shingles.forget):
            held, size = [], 0
            for s in shingles.sets_of(b.column(0).to_pylist()):
                held.append((s & np.uint64(COUNTERS - 1)).astype(np.int64))
                size += len(s)
                if size > 1 << 20:
                    v += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
            if held:
                v += np.bincount(np.concatenate(held), minlength=COUNTERS)
        return v

    total = common.vector_sum(docs.select(F.col(text_col).alias("text")), counts, COUNTERS)
    load = total.sum() / COUNTERS
    noise = load + 6 * np.sqrt(load) + 4
    rank, parts = np.zeros(COUNTERS, np.uint8), np.ones(COUNTERS, np.int16)
    common_ones = np.flatnonzero(total > noise)  # few, and all others keep class 0
    for k in range(0, len(common_ones), 1 << 18):
        at = common_ones[k : k + (1 << 18)]
        rank[at] = np.ceil(4 * np.log2(total[at] / max(noise, 1)) + 1).clip(0, 255)
        parts[at] = np.ceil(total[at] / IN_ONE_TASK).clip(1, 1 << 14)
    return rank, parts


def choose_boundary(info: DataFrame) -> int:
    """The size up to which sets are small: least cost of subset rows below and scanned list entries above."""
    most = largest_small()
    small = info.where(f"n BETWEEN 1 AND {most}").dropDuplicates(["n", "d1", "d2"]).select("n", F.explode("small").alias("h"))
    lists = small.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    cost = {r.n: (r.docs / r.n, r.scan / r.n * prefix_length(r.n)) for r in small.join(lists, "h").groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.sum("k").alias("scan")).collect()}

    def total(b: int) -> float:
        return sum(d * subset_rows(n, b) if n <= b else s for n, (d, s) in cost.items())

    return min(range(most + 1), key=lambda b: (total(b), b))


def postings(docs: DataFrame, text_col: str, order, boundary: int) -> DataFrame:
    """key, d1 and part of each set: one row for each rarest shingle and listed subset. A set is taken once per task.

    part is null but for keys whose lists may be longer than IN_ONE_TASK; those are dealt over several parts.
    """

    def run(batches):
        rank, parts = order.value
        seen: set = set()
        for b in common.slices(batches, ROWS, "shingles", shingles.forget):
            keys, many, owner, times = [], [], [], []
            for s in shingles.sets_of(b.column(0).to_pylist()):
                n = len(s)
                d = shingles.digest(s)
                if not n or d in seen:
                    continue
                seen.add(d)
                mine, dealt = [], []
                over = parts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64)
                if n <= boundary:
                    for c in subset_sizes(n, boundary):
                        if c <= n:
                            at = np.array(list(combinations(range(n), c)))
                            mine.append(shingles.mix(np.add.reduce(shingles.mix(s[at]), 1, dtype=np.uint64) + np.uint64(c)))
                            dealt.append(over[at].min(1))
                if n > boundary or DEN * n >= NUM * (boundary + 1):
                    first = np.argsort(rank[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[: prefix_length(n)]
                    mine.append(s[first])
                    dealt.append(over[first])
                keys += mine
                many += dealt
                owner.append(d[0])
                times.append(sum(map(len, mine)))
            if keys:
                d1, over = np.repeat(np.array(owner, np.int64), times), np.concatenate(many)
                part = pa.array((d1 % over).astype(np.int32), mask=over == 1)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(d1), part], ["key", "d1", "part"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key bigint, d1 bigint, part int")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c, set (8 bytes a shingle, sorted) of the wanted ids."""

    def run(batches):
        for b in common.slices(batches, ROWS, "shingles", shingles.forget):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles.sets_of(b.column(1).to_pylist())], pa.binary())], ["c", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("c"), F.col(text_col).alias("text")).join(wanted, "c", "left_semi")
    return rows.mapInArrow(run, "c bigint, set binary").dropDuplicates(["c"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked: whether their whole sets link."""

    def run(batches):
        for b in common.slices(batches, ROWS, "shingles", shingles.forget):
            a, z = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for p, q in zip(a, z, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(DEN * shared >= NUM * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    ends = common.written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())  # often few: Spark then broadcasts them
    sets = sets.join(ends, "c", "left_semi")
    rows = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("p")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("q")), "b")
    return rows.select("a", "b", "p", "q").mapInArrow(run, "a bigint, b bigint, linked boolean")


_SIZES_FIT = f"{DEN} * least(n, m) >= {NUM} * greatest(n, m)"


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b of the pairs, once each, whose bitmaps differ in no more places than linked sets may."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
            for i, (p, q) in enumerate(zip(b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True)):
                if p and q:
                    apart[i] = max(apart[i], int(np.bitwise_count(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64)).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((NUM + DEN) * apart <= (DEN - NUM) * size))

    own = nodes.select("c", "n", "bits", "wide")
    rows = pairs.distinct().join(own.toDF("a", "n", "p", "wp"), "a").join(own.toDF("b", "m", "q", "wq"), "b")
    return rows.select("a", "b", "n", "m", "p", "q", "wp", "wq").mapInArrow(run, "a bigint, b bigint")


def forests(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which forest takes each edge between vertices x and y, best edges first; ``most`` if none does. The trees of the last.

    The first spans all that the edges join, by the best of them; the second does so with what is left, and so on. So
    an edge that no forest takes runs within one tree of each of them. Trees are given by a vertex of each edge's tree.
    """
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    took, left, root = np.full(len(x), most), np.arange(len(x)), np.arange(len(names))
    for k in range(most):
        if not len(left):
            break
        root, apart = np.arange(len(names)), left
        while True:
            p, q = root[x[apart]], root[y[apart]]
            apart, p, q = apart[p != q], p[p != q], q[p != q]
            if not len(apart):
                break
            best = np.full(len(names), len(x))  # of each tree; the last write is the best edge's
            best[p[::-1]] = apart[::-1]
            other = np.full(len(names), len(x))
            other[q[::-1]] = apart[::-1]
            best = np.minimum(best, other)
            trees = np.flatnonzero(best < len(x))
            edge = best[trees]
            took[edge] = k
            to = np.arange(len(names))
            to[trees] = root[x[edge]] + root[y[edge]] - trees
            both = trees[(to[to[trees]] == trees) & (trees < to[trees])]  # two that chose the same edge
            to[both] = both
            while (to[to] != to).any():
                to = to[to]
            root = to[root]
        left = left[took[left] == most]
    return took, root[x]


def _block_pairs(boundary: int, most: int):
    """Pairs that one pair of blocks proposes: those of so many forests over its components, the most promising first.

    One link joins two components, and what is joined need not be proposed by all its sets: rows grow with the sets of
    the blocks, not with their pairs. ``more`` is set in the last forest where pairs are left: they run within its
    trees, so where its own pairs end in one component nothing is left to propose.

    A pair that shares a short list has been looked at already; others share no more keys than either has in long ones.
    """

    def group(rows: pa.Table, at_blocks: tuple):
        part = rows.column("half").to_numpy()
        c, n, comp, in_long = (rows.column(k).to_numpy() for k in ("c", "n", "comp", "in_long"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(c), -1)
        large = rows.column("wide").is_valid().to_numpy()  # bits of these are too full to tell them apart
        wide, row = np.frombuffer(b"".join(rows.column("wide").drop_null().to_pylist()), np.uint64).reshape(-1, WIDE // 64), np.cumsum(large) - 1
        left, right = (np.flatnonzero(part == 0), np.flatnonzero(part == 1)) if part.max() else (np.arange(len(c)),) * 2
        pairs, score = [], []
        for i in left.tolist():
            size = n[i] + n[right]
            apart = np.bitwise_count(bits[right] ^ bits[i]).sum(1)
            ok = (comp[right] != comp[i]) & (DEN * np.minimum(n[right], n[i]) >= NUM * np.maximum(n[right], n[i])) & ((NUM + DEN) * apart.astype(np.int64) <= (DEN - NUM) * size)
            ok &= (np.minimum(in_long[right], in_long[i]) >= least_shared(n[right], n[i])) | (np.maximum(n[right], n[i]) <= boundary)
            at = np.flatnonzero(ok & (c[right] > c[i]) if left is right else ok)
            if large[i]:
                both = at[large[right[at]]]
                apart[both] = np.maximum(apart[both], np.bitwise_count(wide[row[right[both]]] ^ wide[row[i]]).sum(1))
                at = at[(NUM + DEN) * apart[at].astype(np.int64) <= (DEN - NUM) * size[at]]
            pairs.append(np.stack([np.full(len(at), i), right[at]]))
            score.append(apart[at] / size[at])
        x, y = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)
        low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        order = np.lexsort((c[y], c[x], np.concatenate(score) if score else np.empty(0), high, low))
        x, y, low, high = x[order], y[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(x) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(x)))
        best = np.arange(len(x)) - np.repeat(first, count) < most  # a forest takes one pair of two components at most
        x, y, low, high, left, score = x[best], y[best], low[best], high[best], np.repeat(count > most, count)[best], np.concatenate([*score, []])[order][best]
        order = np.lexsort((c[y], c[x], score))
        x, y, left = c[x[order]], c[y[order]], left[order]
        took, tree = forests(low[order], high[order], most)
        more = (took == most - 1) & np.isin(tree, tree[left | (took == most)])
        x, y, more = x[took < most], y[took < most], more[took < most]
        blocks = [pa.array(np.full(len(x), k)) for k in at_blocks]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(more, pa.bool_()), *blocks], ["a", "b", "more", "key", "i", "j"])

    def run(batches):
        held: list = []  # rows of the pair of blocks that isn't whole yet
        now = None
        for b in batches:
            t = pa.Table.from_batches([b])
            key = np.stack([t.column(k).to_numpy() for k in ("key", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    k = tuple(key[s].tolist())
                    if k != now and held:
                        yield group(pa.concat_tables(held), now)
                        held = []
                    now = k
                    held.append(t.slice(s, e - s))
        if held:
            yield group(pa.concat_tables(held), now)

    return run


def _chunked(rows: DataFrame) -> DataFrame:
    """The rows of each key in chunks of BLOCK (the last may be shorter), ordered by component and size.

    A key may lie in many tasks: each counts its rows of a key, and those of the tasks before are added.
    """

    def run(batches):
        from pyspark import TaskContext

        task, now, size = TaskContext.get().partitionId(), None, 0
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                if k != now:
                    now, size = k, 0
                out.append(size)
                size += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task), pa.int32()), pa.array(out, pa.int64())], [*b.schema.names, "task", "at"])

    order = ["key", "comp", "n", "c"]
    rows = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = common.written(rows.mapInArrow(run, "key bigint, comp bigint, n int, c bigint, task int, at bigint"))
    before = W.partitionBy("key").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("key", "task").agg(F.count(F.lit(1)).alias("k")).withColumn("start", F.sum("k").over(before)).where("start > 0").select("key", "task", "start")
    out = rows.join(starts, ["key", "task"], "left").withColumn("chunk", F.expr(f"(coalesce(start, 0) + at) div {BLOCK}"))
    return out.select(*order, "chunk")


def _blocks(long: DataFrame, held: DataFrame, nodes: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long lists that hold several components, in chunks; the pairs of chunks to scan (key, i, j); c, in_long, bits, wide of the sets."""
    rows = common.written(long.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rows = common.written(rows.join(mixed, "key", "left_semi"))  # ranges are taken from a sample, which would join again
    rows = common.written(_chunked(rows))
    chunks = rows.groupBy("key", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = chunks.alias("x"), chunks.alias("y")
    need = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.chunk") <= F.col("y.chunk"))).where("NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)").where(f"{DEN} * y.most >= {NUM} * x.least AND {DEN} * x.most >= {NUM} * y.least")
    need = common.written(need.select(F.col("x.key").alias("key"), F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j")))
    ends = common.written(rows.select("c").distinct())
    bitmaps = nodes.select("c", "bits", "wide").join(ends, "c", "left_semi").join(held.select("c", "in_long"), "c")
    return rows.select("key", "chunk", "n", "c"), need, common.written(bitmaps)


def _long_pairs(rows: DataFrame, need: DataFrame, bitmaps: DataFrame, comp: DataFrame, boundary: int, most: int) -> DataFrame:
    """a, b, more, key, i, j: pairs proposed by the needed pairs of chunks, between sets of different components."""
    halves = need.select("key", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("half")).union(need.where("i <> j").select("key", F.col("j").alias("chunk"), "i", "j", F.lit(1).alias("half")))
    rows = rows.join(halves, ["key", "chunk"]).join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c"))
    rows = rows.join(bitmaps, "c").select("key", "i", "j", "half", "c", "n", "in_long", "comp", "bits", "wide")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_block_pairs(boundary, most), "a bigint, b bigint, more boolean, key bigint, i bigint, j bigint")


def _unsettled(proposed: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs of chunks that have more to propose between components that are still apart."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    more = proposed.where("more").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return more.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("key", "i", "j").distinct()


def _lists(docs: DataFrame, nodes: DataFrame, text_col: str, order, boundary: int) -> DataFrame:
    """key, c, n, k: the entries of inverted lists that different sets share, k on each."""
    in_list = W.partitionBy("key", "part")
    rows = postings(docs, text_col, order, boundary)
    rows = rows.withColumn("shared", F.col("part").isNotNull() | (F.min("d1").over(in_list) != F.max("d1").over(in_list)))
    rows = common.written(rows.where("shared").select("key", "part", "d1").distinct().select("key", "d1"))
    # a digest of 64 bits may stand for several sets here: each of them gets the entry, and whole sets decide
    entries = common.written(rows.join(nodes.select("d1", "c", "n"), "d1").select("key", "c", "n"))
    common.discard(rows)
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    out = common.written(entries.join(counts, "key").select("key", "c", "n", "k"))
    common.discard(entries)
    return out


def _candidates(lists: DataFrame, held: DataFrame, boundary: int) -> DataFrame:
    """a, b: pairs of short lists, and of long lists each set with one pivot, that may share enough keys.

    Keys shared in short lists are counted; in long lists a pair shares no more than either set has there. The pivot,
    a list's least id, joins most of what belongs together.
    """
    short = lists.where(F.col("k") <= SHORT).groupBy("key").agg(F.collect_list(F.struct("c", "n")).alias("s"))
    short = short.select(F.posexplode("s").alias("i", "x"), "s").select("x", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("y"))
    short = short.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"), F.when(F.col("x.c") < F.col("y.c"), F.col("x.n")).otherwise(F.col("y.n")).alias("n"), F.when(F.col("x.c") < F.col("y.c"), F.col("y.n")).otherwise(F.col("x.n")).alias("m"), F.lit(1).alias("shared"))
    long = lists.where(F.col("k") > SHORT).select("key", "c", "n")
    pivots = long.groupBy("key").agg(F.min(F.struct("c", "n")).alias("p"))
    stars = long.join(pivots, "key").select(F.col("p.c").alias("a"), F.col("c").alias("b"), F.col("p.n").alias("n"), F.col("n").alias("m"), F.lit(0).alias("shared")).where("a < b")
    pairs = short.union(stars).where(_SIZES_FIT).groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    for end in ("a", "b"):
        pairs = pairs.join(held.where("in_long > 0").select(F.col("c").alias(end), F.col("in_long").alias(f"long_{end}")), end, "left")
        pairs = pairs.where(f"greatest(n, m) <= {boundary} OR shared + coalesce(long_{end}, 0) >= {_LEAST_SHARED}")
    return pairs.select("a", "b")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_shingles, class_id, component_id) per input row, ids as long.

    class_id is the smallest id with the same set, component_id the smallest id reachable by links. Null and empty
    texts, and those without words, have n_shingles 0 and are linked with nothing; they are their own class. A row
    with a null id gets its class, which is that of the others; if no other has the set it is null. Repeated rows
    are repeated in the result. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.trim()  # what was fitted before on the driver
    info = common.written(describe(docs, id_col, text_col))
    nodes = common.written(info.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("c"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    order = spark.sparkContext.broadcast(commonness(docs, text_col))
    boundary = choose_boundary(info)
    lists = _lists(docs, nodes, text_col, order, boundary)
    held = common.written(lists.groupBy("c").agg(F.count(F.when(F.col("k") > SHORT, 1)).alias("in_long")))

    pairs = common.written(_candidates(lists, held, boundary))  # often few: Spark then broadcasts them
    new = common.written(_near(pairs, nodes))
    sets = checked = comp = blocks = None
    most = FORESTS
    while True:
        if sets is None or not new.isEmpty():
            ends = new.select(F.explode(F.array("a", "b")).alias("c")).distinct()
            wanted = common.written(ends if sets is None else ends.join(sets, "c", "left_anti"))
            more = common.written(_sets(docs, wanted, id_col, text_col))
            sets = more if sets is None else sets.union(more)
            seen = common.written(verified(new, sets))
            checked = seen if checked is None else checked.union(seen)
            linked = seen.where("linked").select("a", "b")
            if comp is None or not linked.isEmpty():
                # what is linked so far is a forest's worth of edges: each node with its component
                comp = common.written(components(linked if comp is None else linked.union(comp.select("node", "component"))))
        if blocks is None:
            blocks, need, bitmaps = _blocks(lists.where(F.col("k") > SHORT).select("key", "c", "n"), held, nodes, comp)
        else:
            need = common.written(_unsettled(proposed, comp))
            most *= 16
        if need.isEmpty():
            break
        proposed = common.written(_long_pairs(blocks, need, bitmaps, comp, boundary, most))
        new = common.written(proposed.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"))

    named = nodes.select("n", "d1", "d2", "c").join(comp.withColumnRenamed("node", "c"), "c", "left").select("n", "d1", "d2", "c", F.coalesce("component", "c").alias("component"))
    out = info.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    empty = F.col("n") == 0
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("id")).otherwise(F.col("c")).alias("class_id"), F.when(empty, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay: of each group of linked documents the one with the smallest id. Rows with null ids stay."""
    gone = join(docs, id_col, text_col).where("component_id < id").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


#: Words, shingles, sizes, links of all pairs that share a shingle, and what can be reached by links.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, list_sort(list(s)) AS whole FROM sets GROUP BY doc_id),
classes AS (SELECT whole, min(doc_id) AS class_id FROM sizes GROUP BY whole),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id, coalesce(c.class_id, d.doc_id) AS class_id
FROM documents d JOIN least l ON l.x = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN classes c ON c.whole = z.whole
"""
