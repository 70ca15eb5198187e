"""The llm kernels against brute force, libraries and round trips."""

import json
import random
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citaria.llm import canon, garble, neardup, pieces, tokens

TOKENIZER = Path(tokens.TOKENIZERS) / "byte_bpe_50k.json"


# ------------------------------------------------------------------ 1
ENTRIES = [
    ("10", "sumula", "STJ", "Súmula 7 do STJ", ""),
    ("11", "sumula", "STF", "Súmula Vinculante 10", ""),
    ("12", "sumula", "STF", "Súmula 10 do STF", ""),
    ("13", "sumula", "TST", "Súmula 319 do TST", ""),
    ("20", "dispositivo", None, "art. 186 do Código Civil", ""),
    ("21", "dispositivo", None, "art. 5º da Constituição Federal", ""),
    ("22", "dispositivo", None, "art. 1021 do Código de Processo Civil", ""),
    ("23", "dispositivo", None, "art. 1º da Lei das Inelegibilidades", ""),
    ("30", "acordao", "STJ", "REsp 1.599.910/PR", ""),
    ("31", "acordao", "TST", "RR 24173-78.2010.5.07.0112/RS", ""),
]


@pytest.fixture(scope="module")
def names():
    shapes = [(n, c, r[: r.index(d)], r[r.index(d) + len(d) :].lstrip("º"), "") for _, n, c, r, _ in ENTRIES if n != "acordao" and (d := next(w for w in r.replace("º", " ").split() if w.isdigit()))]
    return canon.Canon(canon.Names(shapes), [e[:4] for e in ENTRIES])


@pytest.mark.parametrize(
    "text,want",
    [
        ("Súmula 7 do STJ", "10"), ("5úmula nº 007/STJ", "10"), ("STJ - sum. n.º 7", "10"), ("verbete sumular n. 7 do colendo Superior Tribunal de Justiça", "10"), ("Superior Tribunal de Justiça: enunciado nº 7", "10"), ("Súmmula 7 do Superior Triubnal de Justiça", "10"),
        ("Súmula 7 do STF", None), ("Súmula 7", None), ("súmula do STJ", None), ("Súmula 8 do STJ", None), ("Súmula 7 do S.T.J.", "10"),
        ("Súmula Vinculante nº 10", "11"), ("SV 10", "11"), ("Súmula\nVinculante 10/STF", "11"), ("Súm. Vinc. 10", "11"), ("Súmula 10 do STF", "12"), ("Súmula Vinculante 10 do STJ", None), ("Súmula 10 do STJ", None),
        ("TST, Súmula nº 3l9", "13"), ("Súmula 319 do T.S.T.", "13"), ("Súmula 31G do TST", "13"),
        ("art. 186 do Código Civil", "20"), ("Art.\xa0186, § 1º, II e III, do CC", "20"), ("Código Civil, ARTIGO 186", "20"), ("arts. 186, caput, da Lei n.º 10.406/2002", "20"), ("Atrigo 186 do Cdóigo Civil", "20"), ("art 186 da Lei 10406/02", "20"), ("art. 186 do CPC", None), ("art. 187 do CC", None), ("art. do Código Civil", None), ("art. 186, parágrafo único, do C. Civil", "20"),
        ("art. 5º da CF/88", "21"), ("art. 5o da CRFB", "21"), ("Constituição Federal, art. 5", "21"), ("art. 1.021 do CPC/2015", "22"), ("art. 1º, I, da LC 64/90", "23"), ("art. 1 da Lei Complmentar nº 64/1990", "23"), ("art. 5 da Lei nº 15.521/2031", None),
        ("REsp 1.599.910/PR", "30"), ("AgInt no REsp 1 599 910-PR, rel. Fulana, j. 12/03/2019", "30"), ("Recurso Especial nº 1.S99.9l0", "30"), ("REsp 1.599.911/PR", None), ("TST-RR-24173-78.2010.5.07.0112", "31"), ("RR 0024173 - 78.2010.5.07.0112", "31"), ("RR 24173782010507O112", "31"),
        ("julgado do TST", None), ("a lei processual", None), ("-", None), ("", None), ("12/03/2019", None), ("x" * 5000, None),
    ],
)
def test_mentions(names, text, want):
    assert names.named(text)[4] == (want or "-")


def test_filled_ids(names):
    for value in ("10", "0010", "1.0", "id 10", "doc:10", " 10 "):
        assert names.by_id(value) == "10"
    assert names.by_id("99") is None and names.by_id("nao consta") is None
    assert names.filled("Súmula 7 do STJ")[::4] == ("nome", "10") and names.filled("010")[::4] == ("id", "10")
    assert names.filled("nada")[4] == "-"


def test_many_mentions_in_one_text(names):
    text = " e ".join(f"art. {k} do Código Civil" for k in range(1, 8001))
    began = time.time()
    assert names.named(text)[4] == "20" and time.time() - began < 5


# ------------------------------------------------------------------ 2
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " ", "\n\n", "\r\n", ". ", ", ", "é", "x" * 30, "# T\n", "<p>", "</p>", "- i\n", "😀"]), max_size=60).map("".join), st.integers(1, 60), st.integers(0, 70))
def test_pieces(text, limit, overlap):
    got = pieces.cut(text, limit, overlap)
    own = max(0, min(overlap, limit - 1))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert len(got) == 1 or all(0 < b - a <= limit for a, b, _ in got)
    assert all(c == b - own and d > b for (_, b, _), (c, d, _) in zip(got, got[1:]))


def test_pieces_end_at_boundaries():
    text = "# Um\nfrase um. frase dois.\n\n# Dois\n" + "palavra " * 10 + "\n\nfim do texto."
    kinds = [k for _, _, k in pieces.cut(text, 60, 5)]
    assert "caractere" not in kinds and kinds[-1] == "fim" and "secao" in kinds
    assert pieces.cut("y" * 100, 30, 0) == [(0, 30, "caractere"), (30, 60, "caractere"), (60, 90, "caractere"), (90, 100, "fim")]


def test_siblings_of_one_level_are_merged_only_with_each_other():
    big = "# A\n" + "Uma frase de tamanho médio aqui. " * 8
    small = "# B\nTexto curto da outra parte.\n"
    text = big + "\n" + small + "# C\nfim\n"
    cuts = pieces.cut(text, 120, 0)
    at = text.index("# B")
    assert at in [a for a, _, _ in cuts] and cuts[-1][1] == len(text) and [k for a, b, k in cuts if b == at] == ["secao"]
    assert text[cuts[-1][0] :] == small + "# C\nfim\n"  # whole siblings stay together
    assert all(b - a <= 120 for a, b, _ in cuts) and "".join(text[a:b] for a, b, _ in cuts) == text


# ------------------------------------------------------------------ 5
def test_trie_join_against_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.choice([4, 8, 16, 64])
        x = [(rng.getrandbits(width), i) for i in range(rng.randint(1, 40))]
        x += [(rng.choice(x)[0] ^ (1 << rng.randrange(width)), 100 + k) for k in range(5)]
        y = [(rng.getrandbits(width), 200 + i) for i in range(rng.randint(0, 20))]
        budget = rng.randint(0, width)
        root = neardup.trie(x, 0, width)
        want = sorted((min(i, j), max(i, j)) for k, (a, i) in enumerate(x) for b, j in x[:k] if (a ^ b).bit_count() <= budget)
        assert sorted(tuple(sorted(p)) for p in neardup.trie_join(root, root, budget)) == want
        want = sorted((i, j) for a, i in x for b, j in y if (a ^ b).bit_count() <= budget)
        assert sorted(neardup.trie_join(root, neardup.trie(y, 0, width), budget)) == want


# ------------------------------------------------------------------ 6
@pytest.fixture(scope="module")
def bpe():
    if not TOKENIZER.is_file():
        pytest.skip("no tokenizer files")
    return tokens.PairIndexBPE(str(TOKENIZER))


def ids(bpe, texts):
    counts, flat = bpe.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(TOKENIZER))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_corner_cases(bpe):
    texts = ["", "a" * 3000, "aaab" * 200, "<|endoftext|> x", "   \n\n  x  ", "it's we'll I'D", "ação º ª 😀 漢字", "​­", "\t\t\tx", "é"]
    assert ids(bpe, texts) == library(texts)
    assert ids(bpe, [None, ""]) == [[], []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=80), min_size=1, max_size=10))
def test_ids_of_any_text(bpe, texts):
    assert ids(bpe, texts) == library(texts)


def test_remembered_words_are_bounded(bpe, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 5)
    for texts in (["um dois três quatro"], ["cinco seis um dois"], ["sete oito nove dez onze doze"]):
        assert ids(bpe, texts) == library(texts)


# ------------------------------------------------------------------ 8
CLEAN = "À vista disso, a petição é inútil: “não há dúvida” – art. 5º, § 1º; ação às três. Ícaro já pôs à mão."


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437"])
def test_utf8_read_as_legacy(encoding):
    text = CLEAN.encode("utf-8")
    if encoding == "cp1252":
        bad = "".join(to.decode("cp1252", "ignore") or chr(b) for b in text for to in [bytes([b])])
    else:
        bad = text.decode(encoding)
    found, made, layers, _ = garble.repair(bad)
    assert found and made == CLEAN and layers


@pytest.mark.parametrize("encoding", ["mac_roman", "cp1251", "cp850", "cp437"])
def test_single_byte_mixups(encoding):
    plain = CLEAN.replace("“", '"').replace("”", '"').replace("–", "-")
    found, made, _, _ = garble.repair(plain.encode("cp1252").decode(encoding))
    assert found and made == plain


def test_nested_and_partial():
    bad = CLEAN.replace("Ícaro", "Icaro").encode("utf-8").decode("latin-1")
    twice = bad.encode("utf-8").decode("latin-1")
    assert garble.repair(twice)[1] == CLEAN.replace("Ícaro", "Icaro") and len(garble.repair(twice)[2]) == 2
    part = "Trecho são e límpido. " + "a petição".encode().decode("cp1252") + " segue."
    assert garble.repair(part)[1] == "Trecho são e límpido. a petição segue."


def test_lost_characters_are_reported():
    found, _, layers, left = garble.repair("N�o obstante, a decis�o")
    assert found and not layers and left > 1


@pytest.mark.parametrize(
    "text",
    [CLEAN, CLEAN.upper(), "", None, "ascii", "SÃO PAULO, IRMÃ E AVÔ; ÀS TRÊS", "La petición ¿con qué?", "O nome «Велимира Тростан» e «δίκη»", "ВЕЛИМИРА ТРОСТАН", "razão social 青木商店, € 310,00", "ok 👍🏽 📄", "™ © ® ½ 30 m² 5 °C ±2", "du château, où l’huissier a dressé procès-verbal", "licita&ccedil;&atilde;o", "nao ha duvida", "Não há dúvida", "a​b c­omum", "…”»"],
)
def test_clean_texts_are_no_cases(text):
    assert not garble.repair(text)[0]


def test_vocabulary_is_not_in_the_repository():
    root = Path(__file__).resolve().parents[2]
    assert not [p for p in root.rglob("*.json") if p.stat().st_size > 100_000 and "vocab" in json.loads(p.read_text())]


REAL = "A petição não é nula: o réu não constituiu advogado, e a sentença, já transitada, dispõe sobre a execução às expensas do órgão. “Súmula” nº 7, § 2º."


@pytest.mark.parametrize("read_as", ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "koi8_r", "iso8859_2", "iso8859_7", "iso8859_5", "cp1257", "cp775", "cp737"])
def test_utf8_read_as(read_as):
    text = REAL.replace("“", "").replace("”", "")
    garbled = text.encode("utf-8").decode(read_as, "ignore")
    hit, made, layers, rest = garble.repair(garbled)
    assert hit
    if garbled.encode(read_as) == text.encode("utf-8"):
        assert made == text and rest < 1 and layers


@pytest.mark.parametrize("read_as,meant", [("cp1257", "cp1252"), ("iso8859_5", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("koi8_r", "cp1252")])
def test_one_byte_swaps(read_as, meant):
    text = REAL.replace("“", "").replace("”", "").replace("§ ", "")
    raw = text.encode(meant)
    hit, made, _, _ = garble.repair(raw.decode(read_as, "replace"))
    assert hit
    if "�" not in raw.decode(read_as, "replace"):
        assert made == text


@pytest.mark.parametrize("layers", [1, 2, 5, 6, 7])
def test_any_number_of_layers(layers):
    text = garbled = "Não há ação."
    for _ in range(layers):
        garbled = garbled.encode("utf-8").decode("latin-1")
    hit, made, found, _ = garble.repair(garbled)
    assert hit and made == text and len(found) == layers


def test_letters_lost_without_a_trace_of_bytes():
    for lost in ("A peti??o n?o ? nula", "A pe?a foi juntada e o r?u n?o apelou.", "the trusteeâs request", "the ìnarrowî ground", "the carrierís notice", "O CONDOMÃNIO E A INTIMAÃÃO"):
        assert garble.repair(lost)[0], lost
    for sound in ("Quem apelou? Ninguém.", "Houve dano?sim", "https://a.b/c?id=3&x=y", "A CONSOLIDAÃÇO", "o país e a raiz", "Luís e Paris", "Viajó a París.", "IRMÃ E IRMÃS, AMANHÃ CÃIBRA", "o júri ouviu o réu; e daí?"):
        assert not garble.repair(sound)[0], sound


def test_ascii_texts_with_question_marks_reach_the_operator(spark):
    rows = [(1, "A peti??o n?o ? nula"), (2, "plain text? yes"), (3, None), (4, ""), (5, "é só isso?")]
    got = garble.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.restaurado) for r in got] == [(1, False)]
