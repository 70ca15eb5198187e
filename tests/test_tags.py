"""Tags, offsets, suppression, marking."""

import random
import re

from pyspark.sql import functions as F

from citaria.functions import spans as S
from citaria.operators import tags


def run(spark, rows, f, schema="t string, r string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(f).collect()]


def test_golden_vectors(spark):
    rows = [("a foo b foo", "a <start>foo<end> b <start>foo<end>"), ("x foo\n bar y", "<start>foo bar<end>"), ("quando", "<start> and <end>"), ("abc", "<start>zzz<end>"), ("abc", "<start>\n<end>"), ("a.b (c", "<START x=1>a.b (c<END>"), ("😀 foo", "<start>foo<end>"), ("abc", None), (None, "<start>a<end>")]
    got = run(spark, rows, tags.tag_spans(F.col("t"), F.col("r")))
    assert [None if g is None else [tuple(x) for x in g] for g in got[:8]] == [[(2, 5), (8, 11)], [(2, 10)], [(2, 5)], [], [], [(0, 6)], [(2, 5)], None]
    assert not got[8]


def brute_locate(text, needle):
    needle = needle.strip("\n")
    if not needle:
        return None
    at = text.find(needle)
    if at >= 0:
        return at, at + len(needle)
    words = needle.split()
    if not words:
        return None
    m = re.search(r"\s+".join(map(re.escape, words)), text)
    return m.span() if m else None


def brute(text, raw):
    cursor, found = 0, []
    for m in re.finditer(r"<start\b[^>]*>(.*?)<end>", raw, re.I | re.S):
        needle = m[1].strip("\n")
        if not needle:
            continue
        hit = brute_locate(text[cursor:], needle)
        hit = (hit[0] + cursor, hit[1] + cursor) if hit else brute_locate(text, needle)
        if hit:
            cursor = hit[1]
            found.append(hit)
    out = []
    for a, b in sorted(found):
        if not any(min(b, d) > max(a, c) and 2 * (min(b, d) - max(a, c)) >= (b - a) + (d - c) - (min(b, d) - max(a, c)) for c, d in out):
            out.append((a, b))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice("ab  \nç") for _ in range(rng.randint(0, 40)))
        raw = "".join(rng.choice(["<start>", "<end>", "a", "b", " ", "\n", "ab", "ç "]) for _ in range(rng.randint(0, 20)))
        rows.append((text, raw))
    got = run(spark, rows, tags.tag_spans(F.col("t"), F.col("r")))
    for (text, raw), g in zip(rows, got):
        assert [tuple(x) for x in g] == brute(text, raw), (text, raw)


def test_mark_and_round_trip(spark):
    df = spark.createDataFrame([("a foo b foo", [(2, 5), (8, 11)]), ("aa a", [(1, 2)]), ("abc", []), ("abc", [(2, 9)])], "t string, s array<struct<inicio:int,fim:int>>")
    got = [r[0] for r in df.select(tags.accepted_mark(F.col("t"), F.col("s"))).collect()]
    # the needle "a" of the second text is found at 0, so that its window isn't accepted
    assert got == ["a <start>foo<end> b <start>foo<end>", None, "abc", "abc"]


def test_disjoint_and_segments(spark):
    df = spark.createDataFrame([("abcdefgh", [(0, 2), (1, 3), (3, 3), (4, 6), (7, 99)])], "t string, s array<struct<inicio:int,fim:int>>")
    kept, parts = df.select(S.disjoint(F.col("s"), F.length("t")).alias("k"), S.segments(F.col("t"), S.disjoint(F.col("s"), F.length("t"))).alias("p")).first()
    assert [tuple(x) for x in kept] == [(0, 2), (4, 6)]
    assert [tuple(x) for x in parts] == [("livre", ""), ("fixo", "ab"), ("livre", "cd"), ("fixo", "ef"), ("livre", "gh")]


def test_windows_are_merged_interior_first(spark):
    rows = spark.createDataFrame([("d", 0, 0, 12, 20, "aaaa REsp 1 b", "<start>REsp 1<end>"), ("d", 1, 5, 20, 20, "REsp 1 b cc", "<start>REsp 1<end>"), ("e", 0, 0, 3, 3, "abc", "abc")], "id string, janela int, inicio int, fim int, n_texto int, texto string, raw string")
    got = tags.citations_of_windows(rows, ["id"], 4).collect()
    assert [(r.id, [(c.inicio, c.fim, c.trecho, c.tipo) for c in r.citacoes]) for r in got] == [("d", [(5, 11, "REsp 1", "jurisprudencia")])]
