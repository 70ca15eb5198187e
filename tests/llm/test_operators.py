"""The llm operators on small tables: defined results for nulls, empties, ties, repeats, skew; brute force for pairs."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from citaria.llm import canon, components, crosssplit, garble, mixing, neardup, pieces, tokens
from citaria.llm.queries import ORACLE, QUERIES

MESSAGES = "array<struct<role:string,content:string>>"
CANON = "id_canonico string, natureza string, tribunal string, rotulo string, descricao string"
ROWS = [("10", "sumula", "STJ", "Súmula 7 do STJ", ""), ("20", "dispositivo", None, "art. 186 do Código Civil", ""), ("30", "acordao", "STJ", "REsp 1.599.910/PR", ""), (None, "acordao", None, None, None), ("40", "acordao", "STJ", "HC 111.222/SP", None)]


def chat(text, head="Documento x, posição 0\n"):
    return [("system", "s"), ("user", head + text), ("assistant", "a")]


def test_queries_and_oracles():
    assert set(ORACLE) <= set(QUERIES)
    assert {"p1_found", "p2_found", "p3_found", "p5_found", "p6_ids", "p7_mix", "p8_found"} <= set(QUERIES)


# ------------------------------------------------------------------ 1
def citations(spark):
    rows = [(1, "Súmula 7 do STJ", None), (2, None, ("10",)), (3, " ", ("Súmula 7 do STJ",)), (4, "nada", ("0020",)), (5, "nada", None), (6, "HC 111 222", ("20",)), (6, "HC 111 222", ("20",)), (7, "", None), (8, "x" * 100_000 + " REsp 1.599.910", None)]
    return spark.createDataFrame(rows, "citacao_id bigint, trecho string, resolucao struct<id_canonico:string>").withColumn("via", F.lit("clash"))


@pytest.mark.parametrize("block", [200_000, 1])
def test_mentions_of_a_table(spark, block):
    got = canon.map_mentions(citations(spark), spark.createDataFrame(ROWS, CANON), max_entries=block)
    rows = sorted((r.citacao_id, r.id_canonico, r.via) for r in got.collect())
    assert [r[:2] for r in rows] == [(1, "10"), (2, "10"), (3, "10"), (4, "20"), (5, "-"), (6, "40"), (6, "40"), (7, "-"), (8, "30")]
    assert dict((r[0], r[2]) for r in rows)[3] == "filled_nome"
    assert {r.trecho: r.linhas for r in canon.unmatched(got).collect()} == {"nada": 1, "": 1}


WIDE = [
    ("10", "sumula", "STJ", "Súmula 8 do STJ", "Súmula nº 8 do Superior Tribunal de Justiça"), ("11", "sumula", "STJ", "Súmula 7 do STJ", ""), ("12", "sumula", "TJSP", "Súmula 9 do TJSP", "Súmula nº 9 do Tribunal de Justiça de São Paulo"),
    ("13", "sumula", "TNU", "Súmula 3 da TNU", None), ("14", "dispositivo", None, "art. 5 do Código Penal", "artigo 5 do Código Penal (CP), Decreto-Lei nº 2.848/1940"), ("15", "dispositivo", None, "art. 5 do Código Florestal", "artigo 5 do Código Florestal, Lei nº 12.651/2012"),
    ("16", "enunciado", "FONAJE", "Enunciado Cível 12 do FONAJE", "Enunciado Cível nº 12 do Fórum Nacional de Juizados Especiais"), ("17", "outro", None, "Carta de Princípios da Magistratura", ""), ("18", "dispositivo", None, "art. 7 do Código Comercial Marítimo Nacional", ""), ("19", "dispositivo", None, "art. 7 do Código Comercial Marítimo Regional", ""), ("20", "sumula", "STJ", None, None),
]
NAMED = [
    ("Súmula 8 do STJ e Súmula 7 do STJ", "10"), ("Súmula 7 do STJ, Súmula 8 do STJ", "11"), ("Súmula 9 do TJSP", "12"), ("súmula nº 9, Tribunal de Justiça de São Paulo", "12"), ("Súmula 3 da TNU", "13"), ("art. 5 do Código Penal", "14"), ("art. 5º, CP", "14"), ("artigo 5 do Decreto-Lei 2.848/40", "14"), ("art. 5 da Lei nº 12.651/2012", "15"),
    ("Art. 5, Cód. Florestal", "15"), ("Enunciado Cível 12 do FONAJE", "16"), ("segundo a Carta de Princípios da Magistratura, art. 99", "17"), ("art. 7 do Código Comercial Marítimo", "-"), ("art. 7 do Código Comercial Maritimo Regionl", "19"), ("Súmula 9 do STJ", "-"), ("art. 6 do Código Penal", "-"), ("art. 5 do Código de Processo Penal", "-"),
]


@pytest.mark.parametrize("block", [200_000, 2, 1])
def test_names_come_from_the_list_and_blocks_do_not_matter(spark, block):
    rows = [(k, t, None) for k, (t, _) in enumerate(NAMED)] + [(100, "art. 7 do Código Comercial Marítimo", ("12",)), (101, "nada", ("Súmula 7 do STJ; Súmula 8 do STJ",))]
    c = spark.createDataFrame(rows, "citacao_id bigint, trecho string, resolucao struct<id_canonico:string>")
    got = {r.citacao_id: (r.id_canonico, r.via) for r in canon.map_mentions(c, spark.createDataFrame(WIDE, CANON), max_entries=block).collect()}
    assert {NAMED[k][0]: got[k][0] for k in range(len(NAMED))} == dict(NAMED)
    assert got[12] == ("-", "empate") and got[11][1] == "rotulo" and got[100] == ("12", "id") and got[101] == ("11", "filled_nome")


def test_too_many_names_are_an_error(spark):
    with pytest.raises(ValueError, match="more than 2 ways"):
        canon.shapes_of(spark.createDataFrame(WIDE, CANON), 2)


def test_mentions_of_empty_tables(spark):
    c, r = citations(spark), spark.createDataFrame(ROWS, CANON)
    assert canon.map_mentions(c.limit(0), r).count() == 0
    assert {x.id_canonico for x in canon.map_mentions(c, r.limit(0)).collect()} == {"-"}


# ------------------------------------------------------------------ 2
def test_pieces_of_a_table(spark):
    runs = spark.createDataFrame([("r", 20, 5), ("none", None, None), ("zero", 0, 0), ("wide", 10, 50)], "run string, orcamento int, sobreposicao int")
    rows = [(1, "r", 100, "a" * 50), (2, "r", None, "palavra " * 8), (3, "r", 0, "x" * 20), (4, "r", 0, None), (5, "r", 0, ""), (6, "none", 0, "y" * 99), (7, "unknown", 0, "y" * 99), (8, None, 0, "y" * 99), (9, "zero", 0, "y"), (10, "wide", 0, "z" * 12), (1, "r", 100, "a" * 50)]
    items = spark.createDataFrame(rows, "janela_id bigint, run string, start int, text string").withColumn("posicao", F.lit(0))
    got = pieces.split_items(items, runs).collect()
    assert {r.janela_id for r in got} == {1, 2, 10}
    one = [r for r in got if r.janela_id == 2]
    assert all(r.start is None for r in one) and all(len(r.text) <= 20 for r in one) and {r.n_pecas for r in one} == {len(one)}
    assert sum(r.janela_id == 1 and r.posicao == 1 for r in got) == 2 and {r.start for r in got if r.janela_id == 1 and r.posicao == 1} == {100}
    for a, b in zip(one, one[1:]):
        assert a.text[-5:] == b.text[:5]
    assert pieces.split_items(items.limit(0), runs).count() == 0 and pieces.split_items(items, runs.limit(0)).count() == 0


# ------------------------------------------------------------------ 3 and 5
def sequences(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    w = re.findall("[a-z0-9]+", plain)
    return set(zip(w, w[1:], w[2:]))


def near(a, b):
    return bool(a and b) and len(a & b) >= 0.6 * len(a | b)


def corpus(rng, n):
    vocabulary = [f"p{k}ç" if k % 7 == 0 else f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.35:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocabulary))
            if kind < 0.1:
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            texts.append(" ".join(w).upper() if kind < 0.05 else " ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 80))))
    return texts + ["", "a b", "stock stock", texts[0], texts[0], texts[1]]


def test_cross_split_pairs(spark):
    rng = random.Random(7)
    texts = corpus(rng, 250)
    split = [rng.choice(["treino", "treino", "validacao", "teste", "outra", None]) for _ in texts]
    rows = [(i, s, "o", chat(t), "x") for i, (s, t) in enumerate(zip(split, texts))]
    rows += [(900, "treino", None, None, "x"), (901, "teste", None, [], "x"), (902, "teste", "o", [("system", "s")], "x"), (903, "teste", "o", [("user", None)], "x"), (904, "treino", "o", [("user", "uma linha só de cabeçalho longo")], "x"), (None, "treino", "o", chat(texts[0]), "x")]
    df = spark.createDataFrame(rows, f"exemplo_id bigint, divisao string, origem string, messages {MESSAGES}, sig string")
    sets = {i: sequences(t) for i, t in enumerate(texts)}
    want = {tuple(sorted((i, j))) for i, j in itertools.product(range(len(texts)), repeat=2) if split[i] == "treino" and split[j] in ("validacao", "teste") and near(sets[i], sets[j])}
    got = [(r.exemplo_id_a, r.exemplo_id_b) for r in crosssplit.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    hot = {(r.exemplo_id_a, r.exemplo_id_b) for r in crosssplit.cross_split_pairs(df, side_rows=2).collect()}
    assert hot == want
    held = {j for p in want for j in p if split[j] in ("validacao", "teste")}
    report = crosssplit.leak_report(df).collect()
    assert sum(r.vazados for r in report) == len(held) and sum(r.exemplos for r in report) == sum(s in ("validacao", "teste") for s in split) + 3
    assert crosssplit.cross_split_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    texts = corpus(random.Random(11), 250)
    rows = [(f"d{i:03d}", None, chat(t)) for i, t in enumerate(texts)] + [("e1", 0, None), ("e2", 0, []), ("e3", 0, [("user", "só cabeçalho")])]
    df = spark.createDataFrame(rows, f"documento_id string, inicio int, messages {MESSAGES}").withColumn("grupo", F.lit("clash"))
    sets = [sequences(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if near(sets[i], sets[j]):
            parent[root(j)] = root(i)
    want = {(f"d{i:03d}", f"d{j:03d}") for i, j in itertools.combinations(range(len(texts)), 2) if root(i) == root(j)}
    got = [tuple(r) for r in neardup.group_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert {tuple(r) for r in neardup.group_pairs(df, side_rows=2).collect()} == want
    named = {r.documento_id: (r.grupo, r.tamanho) for r in neardup.groups(df).collect()}
    assert all(named[a][0] == named[b][0] for a, b in want) and len(named) == sum(bool(s) for s in sets)
    assert neardup.group_pairs(df.limit(0)).count() == 0


def test_one_text_in_a_third_of_the_rows(spark):
    base = " ".join(f"w{k}" for k in range(50))
    rows = [(f"d{i}", chat(base if i % 3 == 0 else f"{base} x{i} y{i} z{i}" if i % 3 == 1 else " ".join(f"u{i}k{k}" for k in range(40)))) for i in range(90)]
    df = spark.createDataFrame(rows, f"documento_id string, messages {MESSAGES}")
    sizes = sorted({(r.grupo, r.tamanho) for r in neardup.groups(df, side_rows=10).collect()}, key=lambda x: -x[1])
    assert sizes[0][1] == 60 and len(sizes) == 31


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.id: r.grupo for r in components.components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(60)) and got[5001] == 5000
    assert components.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


# ------------------------------------------------------------------ 6 and 7
def test_ids_of_a_table(spark):
    df = spark.createDataFrame([(1, "ação"), (2, None), (3, ""), (1, "ação"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in tokens.encode(df).collect())
    assert got[0][1] and got[1] == got[2] and [g[1] for g in got[3:]] == [[], []]
    assert tokens.encode(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    n = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert n[2] == n[3] == 0 and n[1] == len(got[1][1])


def mix_tables(spark, weights):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c"]), "palavra " * rng.randint(1, 30)) for i in range(900)]
    rows += [(1000, None, "x"), (1001, "fora", "x y z"), (1002, "a", None), (1003, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("peso", F.lit(1)).withColumn("acumulado", F.lit("clash"))
    return docs, spark.createDataFrame(weights, "source string, peso double, max_repeticoes int")


def test_shares_are_reached(spark):
    docs, mix = mix_tables(spark, [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 9), ("sem_documentos", 0.1, 5), (None, 0.1, 1)])
    rows = mixing.mix_documents(docs, mix).collect()
    total = sum(r.n_tokens for r in rows)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(r.n_tokens for r in rows if r.source == s) / total - w) < 0.01
    assert len({(r.doc_id, r.repeticao) for r in rows}) == len(rows)
    assert max(r.repeticao for r in rows if r.source == "a") <= 2
    assert [r.acumulado for r in rows] == list(itertools.accumulate(r.n_tokens for r in rows))
    assert [r.fim_virtual for r in rows] == sorted(r.fim_virtual for r in rows)
    report = {r.source: r for r in mixing.shares(docs, mix).collect()}
    assert abs(report["b"].alvo - 0.3) < 1e-6 and report["sem_documentos"].alvo is None and report["sem_documentos"].tokens == 0 and report["fora"].peso is None and abs(report["b"].parte - 0.3) < 0.01
    prefix = rows[: len(rows) // 3]
    size = sum(r.n_tokens for r in prefix)
    assert abs(sum(r.n_tokens for r in prefix if r.source == "b") / size - 0.3) < 0.03


def test_budget_and_repetitions(spark):
    docs, mix = mix_tables(spark, [("a", 0.5, 1), ("b", 0.5, 2)])
    small = mixing.mix_documents(docs, mix, budget=500).collect()
    assert 400 <= sum(r.n_tokens for r in small) <= 500
    everything = mixing.mix_documents(docs, mix, budget=10**9).collect()
    uses = {}
    for r in everything:
        uses.setdefault((r.source, r.doc_id), []).append(r.repeticao)
    assert all(sorted(u) == ([1] if s == "a" else [1, 2]) for (s, _), u in uses.items())
    assert mixing.mix_documents(docs, mix, budget=0).count() == 0
    assert mixing.mix_documents(docs.limit(0), mix).count() == 0 and mixing.mix_documents(docs, mix.limit(0)).count() == 0
    assert mixing.shares(docs.limit(0), mix).count() == 2


def test_mix_does_not_depend_on_partitions(spark):
    docs, mix = mix_tables(spark, [("a", 0.7, 2), ("b", 0.3, 4)])
    assert mixing.mix_documents(docs, mix).collect() == mixing.mix_documents(docs.repartition(5), mix).collect()


# ------------------------------------------------------------------ 8
def test_garbled_rows(spark):
    bad = "A petição não é nula".encode().decode("cp1252")
    df = spark.createDataFrame([(1, bad), (2, "A petição"), (3, None), (4, ""), (5, "N�o"), (1, bad), (6, "x" * 50_000 + bad)], "doc_id bigint, text string").withColumn("texto", F.lit("clash"))
    got = sorted((r.doc_id, r.restaurado, r.texto[-20:]) for r in garble.garbled(df).collect())
    assert got == [(1, True, "A petição não é nula"), (1, True, "A petição não é nula"), (5, False, "N�o"), (6, True, "A petição não é nula")]
    assert garble.garbled(df.limit(0)).count() == 0
