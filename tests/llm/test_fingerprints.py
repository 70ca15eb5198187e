"""Codes and their slices: what candidates of problems 3 and 5 are found by, and how much of the work is given up early."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citaria.llm import crosssplit, fingerprints, neardup

MESSAGES = "array<struct<role:string,content:string>>"


def text_of(rng, n=200, stock=()):
    return " ".join([*(f"w{rng.randrange(100_000)}" for _ in range(n - len(stock))), *stock])


def edited(rng, text, share):
    """The text with a share of its words replaced in one run: similarity about (1 - share) / (1 + share)."""
    w = text.split()
    k, at = int(len(w) * share), rng.randrange(len(w))
    for j in range(k):
        w[(at + j) % len(w)] = f"n{rng.randrange(100_000)}"
    return " ".join(w)


def bits(code):
    return int.from_bytes(np.asarray(code, np.int64).astype(">i8").tobytes()) >> (64 * fingerprints.CODE_WORDS - fingerprints.CODE_BITS)


def test_join_keys_are_slices_of_the_code(spark):
    rng = random.Random(1)
    rows = [(str(k).encode(), text_of(rng)) for k in range(20)]
    coded = fingerprints.sketch(spark.createDataFrame(rows, "sig binary, t string"), ["sig"], "t")
    for r in coded.select("code", fingerprints.slices().alias("s")).collect():
        whole = bits(r.code)
        want = [whole >> (fingerprints.CODE_BITS - 48 * (k + 1)) & (1 << 48) - 1 | k << 48 for k in range(fingerprints.BLOCKS)]
        assert list(r.s) == want
        for k in (0, 5, 41):
            turned = neardup.rotated(whole, k)
            assert turned & (1 << 48) - 1 == want[k] & (1 << 48) - 1  # slice k last: equal in a trie, all below it first
            assert turned >> (fingerprints.CODE_BITS - 48) == want[(k + 1) % fingerprints.BLOCKS] & (1 << 48) - 1
    assert coded.columns == ["sig", "code"]


def test_radius_and_budget_keep_near_texts_and_give_up_others():
    rng, own = random.Random(2), fingerprints.Sketcher(3)
    code = lambda t: bits(fingerprints.code_of(fingerprints.minima(own.sequences(t))).astype(np.int64))
    allowed, kept, equal = neardup.budgets(fingerprints.RADIUS), 0, 0
    for _ in range(60):
        a = text_of(rng)
        b = edited(rng, a, 0.23)
        x, y = own.sequences(a), own.sequences(b)
        s = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert 0.58 < s < 0.66
        p, q = code(a), code(b)
        assert (p ^ q).bit_count() <= fingerprints.RADIUS
        found = 0
        for k in range(fingerprints.BLOCKS):
            u, v = neardup.rotated(p, k), neardup.rotated(q, k)
            if (u ^ v) & (1 << 48) - 1 == 0:
                equal += 1
                found += bool(list(neardup.trie_join(neardup.trie([(u, 1)]), neardup.trie([(v, 2)]), allowed)))
        assert found
        kept += found
    assert kept > 0.97 * equal
    codes = [(code(text_of(rng)), k) for k in range(200)]
    root, steps = neardup.trie(codes), [0, 0]
    assert not list(neardup.trie_join(root, root, allowed, steps))
    assert steps[1] > 0.8 * 200 * 199 / 2 * 0.5 and steps[1] / steps[0] > 0.4


def stock_table(spark, n, share=0.5):
    rng = random.Random(3)
    stock = [f"s{k}" for k in range(int(200 * share))]
    texts = [text_of(rng, 200, stock) for _ in range(n)]
    texts += [edited(rng, t, 0.1) for t in texts[:20]]
    return texts


def test_stock_passage_is_split_by_further_slices(spark):
    texts = stock_table(spark, 300)
    rows = [(f"d{k:04d}", k, "treino" if k < 300 else "teste", "o", [("user", f"x\n{t}")]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"documento_id string, exemplo_id bigint, divisao string, origem string, messages {MESSAGES}")
    want = {(f"d{k:04d}", f"d{300 + k:04d}") for k in range(20)}
    assert {tuple(r) for r in neardup.group_pairs(df, side_rows=20).collect()} == want
    got = crosssplit.cross_split_pairs(df, side_rows=4).select("exemplo_id_a", "exemplo_id_b").collect()
    assert {tuple(r) for r in got} == {(k, 300 + k) for k in range(20)}
    whole = fingerprints.slice_rows(neardup.representatives(neardup.members(df, "documento_id"), 3), ["rep"])
    sizes = lambda d: d.groupBy("block").count().where("count > 20")
    hot = whole.join(sizes(whole).select("block"), "block").withColumn("level", F.lit(0))
    reps = neardup.representatives(neardup.members(df, "documento_id"), 3)
    split = fingerprints.finer(hot, reps, "rep")
    pairs = lambda d: sum(r["count"] ** 2 for r in d.groupBy("block").count().collect())
    assert split.count() == fingerprints.SPLITS * hot.count() and pairs(split) < pairs(hot)
    assert {r.level for r in split.select("level").distinct().collect()} == {1}


def codes_with_one_equal_slice(rng, n):
    """n codes of one first slice; two of them differ in one or two bits of every other slice."""
    base = rng.getrandbits(fingerprints.CODE_BITS)
    spare = 64 * fingerprints.CODE_WORDS - fingerprints.CODE_BITS
    for j in range(n):
        code = (base ^ sum(1 << 48 * k + j for k in range(fingerprints.BLOCKS - 1))) << spare
        yield np.frombuffer(code.to_bytes(8 * fingerprints.CODE_WORDS), ">i8").astype(np.int64).tolist()


def test_pairs_across_splits_do_not_depend_on_the_size_of_a_slice(spark):
    rows = [(f"c{j}".encode(), j % 2 == 0, j % 2 == 1, c) for j, c in enumerate(codes_with_one_equal_slice(random.Random(5), 12))]
    reps = spark.createDataFrame(rows, "sig binary, in_train boolean, in_eval boolean, code array<bigint>")
    crosssplit.shared_checkpoints(spark)
    want = {(f"c{i}".encode(), f"c{j}".encode()) for i in range(0, 12, 2) for j in range(1, 12, 2)}
    for side_rows in (2_000, 4, 1):
        got = [(bytes(r.sig_t), bytes(r.sig_e)) for r in crosssplit.candidate_pairs(reps, fingerprints.RADIUS, side_rows).collect()]
        assert len(got) == len(want) and set(got) == want, side_rows


def test_groups_do_not_depend_on_the_size_of_a_slice(spark, monkeypatch):
    monkeypatch.setattr(neardup, "verified", lambda pairs, a, b, *_: pairs.select(a, b, F.lit(1.0).alias("similaridade")))
    neardup.shared_checkpoints(spark)
    rng, low = random.Random(6), fingerprints.CODE_BITS - 48
    spare = 64 * fingerprints.CODE_WORDS - fingerprints.CODE_BITS
    first = rng.getrandbits(48) << low
    every = sum(1 << 48 * k for k in range(fingerprints.BLOCKS - 1))  # a bit of each slice but the first
    early = ((1 << 200) - 1) << low - 200  # many errors at once below the first slice
    codes, want = [], set()
    for j in range(6):
        code = first | rng.getrandbits(low)
        codes += [code, code ^ (every if j % 2 else every | early)]
        want.add((f"c{2 * j:02d}", f"c{2 * j + 1:02d}"))
    rows = [(f"c{j:02d}", np.frombuffer((c << spare).to_bytes(8 * fingerprints.CODE_WORDS), ">i8").astype(np.int64).tolist()) for j, c in enumerate(codes)]
    reps = spark.createDataFrame(rows, "rep string, code array<bigint>")
    for side_rows in (500, 5, 1):
        got = neardup.links(reps, reps, 0.6, 3, fingerprints.RADIUS, side_rows).collect()
        assert {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in got} == want, side_rows


@pytest.mark.parametrize("hub", [1, 5_000])
def test_pairs_of_a_hub(spark, monkeypatch, hub):
    monkeypatch.setattr(fingerprints, "HUB_PAIRS", hub)
    rng = random.Random(4)
    base = text_of(rng)
    texts = spark.createDataFrame([(b"a", base)] + [(f"b{k}".encode(), edited(rng, base, 0.02 if k % 2 else 0.9)) for k in range(10)] + [(b"a", base)], "sig binary, text string")
    pairs = spark.createDataFrame([(b"a", f"b{k}".encode()) for k in range(10)], "x binary, y binary")
    neardup.shared_checkpoints(spark)
    got = fingerprints.verified(pairs, "x", "y", texts, 0.6, 3).collect()
    assert sorted(bytes(r.y).decode() for r in got) == [f"b{k}" for k in (1, 3, 5, 7, 9)]
