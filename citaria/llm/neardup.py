"""Problem 5: groups of records that share most of their text.

Method: binary trie self-join. The codes of the distinct texts (see fingerprints.py) are
held in binary tries; a self-join walks pairs of nodes together, adds up the bits in which
their paths differ, and gives up a pair of subtrees when the sum passes the error budget.
Pairs that reach the leaves within the budget are verified on the texts; groups are the
connected components of the verified links.

The tries are taken in rotations of the code: in rotation k slice k comes first, and a
trie holds the texts of one value of it, so that the shuffle by (k, value) makes the
tries' first level. The budget is the radius: two texts are candidates if they have an
equal slice and their codes lie within the radius, whatever else the tries hold. At
similarity 0.6 a pair has nine equal slices on average, and none with probability 4e-5.

Scale: exact copies are one representative; slices of one text are dropped by a
pre-aggregated count. A hot slice is first compared with one of its texts (the pivot),
the members of whose group need not meet each other again. The others (a stock passage)
are cut into sub-blocks of about SIDE_ROWS codes, and every two sub-blocks are joined as
two tries in a task of their own. Every pair that isn't in one group already meets, so
that the groups don't depend on how many texts share a slice.

Defined results: records without messages, without a user message or of fewer than three
words after its first line are in no group; other columns, nulls in them included, are
ignored; records of the same id are one record.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.llm.components import components
from citaria.llm.fingerprints import CODE_BITS, CODE_WORDS, RADIUS, SLICE_BITS, hamming, keyed, sketch, slice_rows, unpacked, user_text, verified
from citaria.session import shared_checkpoints

#: Codes of a trie; a pair of tries of this size costs a task a quarter of a second at most.
SIDE_ROWS = 500
#: Errors allowed below an equal slice beyond those that the depth allows.
SLACK = 24
#: Bits that a walk compares at once on a long path before it looks at the budget again.
STRIDE = 2 * SLICE_BITS


class Node:
    """A trie node: the bits of the path from its parent, and either two children or the ids that end here."""

    __slots__ = ("bits", "size", "low", "high", "ids")

    def __init__(self, bits: int, size: int, low=None, high=None, ids=None):
        self.bits, self.size, self.low, self.high, self.ids = bits, size, low, high, ids


def trie(codes: list[tuple[int, object]], depth: int = 0, width: int = CODE_BITS) -> Node | None:
    """A path-compressed binary trie over (code, id), built from the sorted codes without recursion on bits."""
    if not codes:
        return None
    codes = sorted(codes, key=lambda c: c[0])
    return _trie([c for c, _ in codes], [i for _, i in codes], 0, len(codes), depth, width)


def _trie(codes: list[int], ids: list, a: int, b: int, depth: int, width: int) -> Node:
    left = width - depth
    mask = (1 << left) - 1
    if codes[a] == codes[b - 1]:
        return Node(codes[a] & mask, left, ids=ids[a:b])
    shared = left - ((codes[a] ^ codes[b - 1]) & mask).bit_length()
    under = left - shared - 1
    lo, hi, bit = a, b - 1, 1 << under
    while lo < hi:  # the first code with the next bit set
        mid = (lo + hi) // 2
        if codes[mid] & bit:
            hi = mid
        else:
            lo = mid + 1
    at = depth + shared + 1
    return Node((codes[a] & mask) >> (left - shared), shared, _trie(codes, ids, a, lo, at, width), _trie(codes, ids, lo, b, at, width))


def budgets(radius: int, width: int = CODE_BITS) -> list[int]:
    """Errors allowed after d bits below the first slice of a rotation, for walks that may give up more than the radius does.

    Not used for groups: what such a walk gives up depends on where the tries branch, and so on their other texts.
    """
    return [min(radius, SLACK + d * radius // width) for d in range(width + 1)]


def trie_join(x: Node | None, y: Node | None, budget: int | list[int], steps: list[int] | None = None) -> Iterator[tuple[object, object]]:
    """Pairs of ids of two tries (or of one with itself, once each) whose codes differ within the budget.

    budget: bits for the whole path, or for each depth. steps: [pairs of nodes met, pairs given up], counted up.
    """
    if x is None or y is None:
        return
    allowed = budget if isinstance(budget, list) else None
    cap = budget if allowed is None else allowed[-1]
    met = pruned = 0
    # a task: nodes, bits of each one's path that the other has not been compared with yet, depth, errors so far
    todo = [(x, x.bits, x.size, y, y.bits, y.size, 0, 0)]
    while todo:
        p, pb, ps, q, qb, qs, d, err = todo.pop()
        if p is q and ps == p.size and qs == q.size:
            if p.ids is not None:
                for i, u in enumerate(p.ids):
                    for v in p.ids[i + 1 :]:
                        yield u, v
                continue
            lo, hi = p.low, p.high
            d += ps + 1
            todo.append((lo, lo.bits, lo.size, lo, lo.bits, lo.size, d, err))
            todo.append((hi, hi.bits, hi.size, hi, hi.bits, hi.size, d, err))
            if err < (cap if allowed is None else allowed[d]):
                todo.append((lo, lo.bits, lo.size, hi, hi.bits, hi.size, d, err + 1))
            continue
        met += 1
        n = ps if ps < qs else qs
        while n and allowed is not None and n > STRIDE:  # long paths in strides
            err += ((pb >> (ps - STRIDE)) & MASK ^ (qb >> (qs - STRIDE)) & MASK).bit_count()
            n, ps, qs, d = n - STRIDE, ps - STRIDE, qs - STRIDE, d + STRIDE
            if err > allowed[d]:
                break
        else:
            err += ((pb >> (ps - n) ^ qb >> (qs - n)) & LOW_BITS[n]).bit_count()
            d += n
        if err > (cap if allowed is None else allowed[d]):
            pruned += 1
            continue
        ps -= n
        qs -= n
        ways = ((p.low, 0), (p.high, 1)) if ps == 0 and p.ids is None else None
        other = ((q.low, 0), (q.high, 1)) if qs == 0 and q.ids is None else None
        if ways and other:
            for c, cb in ways:
                for e, eb in other:
                    if (now := err + (cb ^ eb)) <= (cap if allowed is None else allowed[d + 1]):
                        todo.append((c, c.bits, c.size, e, e.bits, e.size, d + 1, now))
        elif ways:
            for c, cb in ways:
                # the branching bit of p still has to meet a bit of q
                todo.append((c, cb << c.size | c.bits, c.size + 1, q, qb, qs, d, err))
        elif other:
            for e, eb in other:
                todo.append((p, pb, ps, e, eb << e.size | e.bits, e.size + 1, d, err))
        elif ps == 0 and qs == 0:
            for u in p.ids:
                for v in q.ids:
                    yield u, v
        # else one path is longer than the other: can't be, all codes have the same length
    if steps is not None:
        steps[0] += met
        steps[1] += pruned


MASK = (1 << STRIDE) - 1
#: Masks of the last n bits; bits of a path that have been compared stay above them.
LOW_BITS = [(1 << n) - 1 for n in range(CODE_BITS + 1)]


def rotated(code: int, k: int) -> int:
    """The bits of a code below slice k, from the slice after it round to the slice before it."""
    turn = SLICE_BITS * (k + 1) % CODE_BITS
    return (code << turn | code >> (CODE_BITS - turn)) & ((1 << CODE_BITS) - 1) if turn else code


def code_ints(codes: pa.ListArray) -> list[int]:
    """Codes as whole numbers of CODE_BITS bits."""
    raw = codes.flatten().to_numpy(zero_copy_only=False).astype(">i8").tobytes()
    size, spare = 8 * CODE_WORDS, 64 * CODE_WORDS - CODE_BITS
    return [int.from_bytes(raw[at : at + size]) >> spare for at in range(0, len(raw), size)]


def members(records: DataFrame, key: str) -> DataFrame:
    """(key, sig, text) of the records that have a text."""
    return keyed(records.where(F.col(key).isNotNull()).select(key, user_text().alias("_t")), [key], "_t")


def representatives(rows: DataFrame, width: int) -> DataFrame:
    """(rep, code) of every distinct text, by its digest, written once. Texts are read where they lie; only codes are shuffled."""
    shared_checkpoints(rows.sparkSession)
    coded = sketch(rows, ["sig"], "text", width)
    return coded.groupBy(F.col("sig").alias("rep")).agg(F.first("code").alias("code")).checkpoint()


def sized(members: DataFrame) -> DataFrame:
    """members (rep, k, level, block, inside) with the counts n_in and n_out of their block; blocks without pairs to meet are dropped."""
    counts = members.groupBy("block").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"))
    return members.join(counts.where("n_out > 0 and n_in + n_out > 1"), "block")


def placed_in_grid(members: DataFrame, side_rows: int) -> DataFrame:
    """(rep, k, block, _i, _j, _at): the cells of each block's grid that a text belongs to.

    Sub-block i meets every sub-block j in the cell (min, max). Texts inside a linked
    group are sub-blocks of their own, and only cells with texts outside it are made.
    """
    placed = members.withColumns({"_k1": F.ceil(F.col("n_in") / side_rows).cast("int"), "_k2": F.ceil(F.col("n_out") / side_rows).cast("int")})
    h = F.xxhash64("rep")
    at = F.when(F.col("inside"), F.pmod(h, F.greatest("_k1", F.lit(1)))).otherwise(F.col("_k1") + F.pmod(h, F.greatest("_k2", F.lit(1)))).cast("int")
    low = F.when(F.col("inside"), F.col("_k1")).otherwise(F.lit(0))
    cells = placed.select("rep", "k", "block", at.alias("_at"), F.explode(F.sequence(low, F.col("_k1") + F.col("_k2") - 1)).alias("_other"))
    return cells.select("rep", "k", "block", F.least("_at", "_other").alias("_i"), F.greatest("_at", "_other").alias("_j"), "_at")


def trie_candidates(cells: DataFrame, reps: DataFrame, radius: int) -> DataFrame:
    """(a, b): texts that meet in a cell and whose codes lie within the radius, by joins of tries in the cell's rotation."""
    coded = cells.join(reps.select("rep", "code"), "rep").select("rep", "k", "block", "_i", "_j", "_at", "code")
    kind = reps.schema["rep"].dataType.simpleString()
    spread = coded.repartition("block", "_i", "_j").sortWithinPartitions("block", "_i", "_j", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * CODE_BITS))  # a trie may be as deep as a code is long
        now, sides, out = None, {}, []

        def flush():
            if len(sides) == 1 and now is not None and now[1] == now[2]:
                (only,) = sides.values()
                if len(only) > 1:
                    root = trie(only)
                    out.extend(trie_join(root, root, radius))
            elif len(sides) == 2:
                x, y = sides.values()
                out.extend(trie_join(trie(x), trie(y), radius))

        def batch_of(pairs):
            a, b = zip(*((u, v) if u < v else (v, u) for u, v in pairs))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            codes = code_ints(batch.column(6))
            for rep, k, block, i, j, at, code in zip(*(c.to_pylist() for c in batch.columns[:6]), codes):
                if (block, i, j) != now:
                    flush()
                    now, sides = (block, i, j), {}
                    if len(out) >= 20_000:
                        yield batch_of(out)
                        out.clear()
                sides.setdefault(at, []).append((rotated(code, k), rep))
        flush()
        if out:
            yield batch_of(out)

    return spread.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def spokes(hot: DataFrame, rows: DataFrame, reps: DataFrame, radius: int) -> DataFrame:
    """(a, b): the texts of hot blocks (block, pivot) whose codes lie within the radius of the pivot's."""
    near = rows.join(hot, "block").where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    near = near.join(reps.select(F.col("rep").alias("a"), *unpacked("code", "x")), "a").join(reps.select(F.col("rep").alias("b"), *unpacked("code", "y")), "b")
    return near.where(hamming("x", "y") <= radius).select("a", "b")


def links(rows: DataFrame, reps: DataFrame, similarity: float, width: int, radius: int, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(a, b, similaridade): verified pairs of representatives, whose components are the groups; side_rows changes only how they are found.

    Pairs of texts that the comparison with a hot block's pivot has already put in one group may be left out.
    """
    segments = slice_rows(reps, ["rep"])
    shared = segments.groupBy("block").agg(F.count(F.lit(1)).alias("n_out"), F.min(F.xxhash64("rep")).alias("_h")).where("n_out > 1").checkpoint()  # numbers only: aggregated by hash, not by sort
    hot = shared.where(F.col("n_out") > side_rows)
    if hot.isEmpty():
        members = segments.join(shared.select("block", F.lit(0).alias("n_in"), "n_out"), "block").withColumn("inside", F.lit(False))
        return verified(trie_candidates(placed_in_grid(members, side_rows), reps, radius), "a", "b", rows, similarity, width)
    hot = segments.join(hot, "block").where(F.xxhash64("rep") == F.col("_h")).groupBy("block").agg(F.min("rep").alias("pivot")).checkpoint()
    first = verified(spokes(hot, segments, reps, radius), "a", "b", rows, similarity, width).checkpoint()
    labels = components(first, "a", "b").withColumnsRenamed({"id": "rep", "grupo": "_label"})
    # of the groups so far the largest of each block, hot or not: its members needn't meet there
    seen = segments.join(shared.select("block"), "block").join(labels, "rep", "left")
    homes = seen.where("_label is not null").groupBy("block", "_label").agg(F.count(F.lit(1)).alias("_n"))
    homes = homes.groupBy("block").agg(F.max_by("_label", F.struct("_n", "_label")).alias("_home"))
    members = seen.join(homes, "block", "left").select("rep", "k", "block", F.coalesce(F.col("_label") == F.col("_home"), F.lit(False)).alias("inside"))
    rest = trie_candidates(placed_in_grid(sized(members), side_rows), reps, radius)
    return first.unionByName(verified(rest, "a", "b", rows, similarity, width)).dropDuplicates(["a", "b"])


def groups(records: DataFrame, key: str = "documento_id", similarity: float = 0.6, width: int = 3, radius: int = RADIUS, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(key, grupo, tamanho): each record with a text of `width` words or more, the smallest id of its group, and the group's size."""
    rows = members(records, key)
    reps = representatives(rows, width)
    found = components(links(rows, reps, similarity, width, radius, side_rows), "a", "b").withColumnsRenamed({"id": "sig", "grupo": "_g"})
    classes = reps.select(F.col("rep").alias("sig")).join(found, "sig", "left").select("sig", F.coalesce("_g", "sig").alias("_g"))
    named = rows.select(key, "sig").join(classes, "sig").select(key, "_g").distinct()
    sizes = named.groupBy("_g").agg(F.count(F.lit(1)).alias("tamanho"), F.min(key).alias("grupo"))
    return named.join(sizes, "_g").select(key, "grupo", "tamanho")


def group_pairs(records: DataFrame, key: str = "documento_id", similarity: float = 0.6, width: int = 3, radius: int = RADIUS, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(key_a, key_b): every pair of records of a group, smaller first."""
    named = groups(records, key, similarity, width, radius, side_rows).where("tamanho > 1").select(key, "grupo")
    a, b = named.withColumnRenamed(key, f"{key}_a"), named.withColumnRenamed(key, f"{key}_b")
    return a.join(b, "grupo").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
