"""Golden vectors of the text scalars."""

import pytest
from pyspark.sql import functions as F

from citaria.functions import text as T


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_accents_and_base(spark):
    assert values(spark, T.strip_accents, "Súmula nº", "ação", None, "", "ação") == ["Sumula no", "acao", None, "", "acao"]
    assert values(spark, T.base_form, "  CÓDIGO \n de Processo ", None) == ["codigo de processo", None]


def test_numbers_of_citations(spark):
    got = values(
        spark, T.cited_numbers,
        "REsp 1.5O0.12l/SP", "AgInt no REsp 1.599.910/PR", "TST-RR-1000-11.2019.5.03.0001", "Rcl 88.860/PE e Rcl 88.861/PE",
        "julgado em 12/03/2019", "… julgado em 2019 …", "REsp 123", None, "",
    )
    assert got == [["1500121"], ["1599910"], ["10001120195030001"], ["88860", "88861"], [], [], [], None, []]


@pytest.mark.parametrize("court,want", [("TST", ["10001120195030001"]), ("STJ", ["1234567", "201501234567"]), ("STF", ["1234567"])])
def test_header_numbers(spark, court, want):
    text = "PROCESSO Nº TST-RR-1000-11.2019.5.03.0001" if court == "TST" else "RECURSO ESPECIAL Nº 1.234.567 - SP (2015/0123456-7) RELATOR"
    df = spark.createDataFrame([(court, text)], "c string, t string")
    assert df.select(T.header_numbers(F.col("c"), F.col("t"))).first()[0] == want


def test_codes(spark):
    got = values(spark, T.cited_code, "art. 186 do Código Civil", "art. 12 da Lei nº 1.234/2000", "Lei n. 13.105/2015", "art. 5º", "art. 1º, I, da Lei Complementar nº 64/1990", "art. 5 da CF", None)
    assert got == ["cc", "lei-1234-2000", "cpc", None, "lc64", "cf", None]
    assert values(spark, T.cited_article, "art. 1.021 do CPC", "artigo 007", "lei", None) == ["1021", "7", None, None]
    assert values(spark, T.corpus_article, "Art. 1.021 x", "Artigo 5", None) == ["1", None, None]
    assert values(spark, T.corpus_code, "… crimes contra a ADMINISTRAÇÃO MILITAR …", "fornecedor", "o fornecedor e o consumidor", None) == ["cpm", None, "cdc", None]


def test_sumulas(spark):
    assert values(spark, T.cited_sumula, "5úmula nº 007/STJ", "súmula do STJ", "Súm. 12", None) == ["7", None, "12", None]
    assert values(spark, T.cited_court, "Súmula 7 do stj", "Súmula 7") == ["STJ", None]
    assert values(spark, T.sumula_seen, "SÚMULA 7", "súm. 3", "sumo") == [True, True, False]


def test_ids_and_types(spark):
    assert values(spark, T.norm_id, " 007 ", "000", "12a", "") == ["7", "0", "12a", ""]
    assert values(spark, T.list_of_ids, "1:2  3", "-", None, "") == [["1", "2", "3"], [], [], []]
    assert values(spark, T.citation_type, "art. 5º da CF", "REsp 12", "LEI 8", "normas de regência") == ["lei", "jurisprudencia", "lei", "lei"]
    assert values(spark, T.useful_number, "123", "1234", "1999", "20190") == [False, True, False, True]


def test_accents_against_the_unicode_tables(spark):
    """Every letter that isn't a Hangul syllable, alone and between others."""
    import unicodedata

    def want(t):
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))

    letters = [chr(c) for c in (*range(1, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, T.LAST_LETTER))]
    texts = ["".join(letters[k : k + 97]) for k in range(0, len(letters), 97)] + ["ﬁnal №", None, "", "São João… ½ ™ ﬀ ç\u0327 ş ő ２０ ª º"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.o for r in df.select("k", T.strip_accents(F.col("t")).alias("o")).collect()}
    assert [k for k, t in enumerate(texts) if got[k] != (None if t is None else want(t))] == []
    assert got[len(texts) - 4] == "final No"


def test_checksum(spark):
    import zlib

    texts = ["", "a", "Wikipedia", "ação 😀", "x" * 70_000]
    assert values(spark, T.checksum, *texts, None) == [*(zlib.adler32(t.encode()) % 10_000 for t in texts), None]
