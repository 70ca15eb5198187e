"""Queries of the text scalars, corpus derivation and resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaria.functions import text as T
from citaria.operators import resolve as R
from citaria.plans import views as V
from citaria.session import table

# White space as Java's (?U)\s has it, for RE2, whose \s is ASCII only.
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


#: What compatibility decomposition does beyond DuckDB's strip_accents, as far as court texts have it: signs of
#: ordinals and powers, odd spaces, lone accents, full width, and those that become several.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ODD = "ªº²³¹µ\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000´¨¸¯˘˙˚˛˜˝" + _WIDE
_EVEN = "ao231μ" + " " * 25 + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_SEVERAL = {"…": "...", "™": "TM", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "№": "No", "ﬁ": "fi", "ﬂ": "fl"}


def A(x: str) -> str:
    x = rf"strip_accents(regexp_replace({x}, '[\x{{300}}-\x{{36F}}]', '', 'g'))"
    for a, b in _SEVERAL.items():
        x = f"replace({x}, '{a}', '{b}')"
    return "translate({0}, '{1}', '{2}')".format(x, _ODD, _EVEN.replace("'", "''"))


def B(x: str) -> str:
    return f"trim(regexp_replace(lower({A(x)}), '{WS}+', ' ', 'g'))"


def D(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def Z(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END"


def X(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{ws(pattern)}', {group}, 'i'), '')"


def ws(pattern: str) -> str:
    return pattern.replace(r"[\d.\-/]\s*", r"[\d.\-/]" + WS + "*").replace(r"\s", WS)


def cited_code_sql(x: str) -> str:
    b = "b"
    number, year = Z(D(X(b, T.LAW_NUMBER, 1))), X(b, T.LAW_NUMBER, 2)
    arms = "".join(f" WHEN k = '{k}' THEN '{c}'" for k, c in T.LAW_ALIASES.items())
    cascade = "".join(f" WHEN contains(b, '{phrase}')" + (rf" OR regexp_matches(b, '\b{ab}\b')" if ab else "") + f" THEN '{c}'" for c, phrase, ab in T.CITED_CODES)
    return f"CASE WHEN y IS NOT NULL THEN CASE WHEN contains(b, 'complementar') AND k = '64/1990' THEN 'lc64'{arms} ELSE 'lei-' || n || '-' || y END{cascade} END", f"SELECT *, n || '/' || y AS k FROM (SELECT *, {number} AS n, {year} AS y FROM (SELECT *, {B(x)} AS b FROM @src))"


def corpus_code_sql(b: str) -> str:
    arms = []
    for code, alternatives in T.CORPUS_CODES:
        hit = " OR ".join("(" + " AND ".join(f"contains({b}, '{p}')" for p in phrases) + ")" for phrases in alternatives)
        arms.append(f" WHEN {hit} THEN '{code}'")
    return f"CASE{''.join(arms)} END"


def _c(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extract_citacoes").select("citacao_id", "trecho", F.col("resolucao.id_canonico").alias("marcado"))


def scalar(**cols) -> callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _c(spark, sf).select("citacao_id", *(f(F.col("trecho")).alias(n) for n, f in cols.items()))

    return query


def scalar_sql(**cols: str) -> str:
    return "SELECT citacao_id, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM extract_citacoes"


def norm_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).select("citacao_id", T.norm_id(F.col("marcado")).alias("id_normal"))


def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "goldenset")
    return g.select("linha_id", F.size(T.list_of_ids(F.col("id_canonico"))).alias("n"), F.array_join(T.list_of_ids(F.col("id_canonico")), "|").alias("ids"))


def article_and_code(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("trecho")
    return _c(spark, sf).select("citacao_id", T.cited_article(t).alias("artigo"), T.cited_code(t).alias("diploma"))


_code_expr, _code_src = cited_code_sql("trecho")
_ARTICLE = Z(f"nullif({D(X('trecho', T.ARTICLE_CITED))}, '')")
_SUMULA = Z(X(A("trecho"), T.SUMULA_CITED))
_COURT = f"upper({X('trecho', T.COURT)})"
_BINDING = "regexp_matches(trecho, 'vinculante', 'i')"


def cited_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).select("citacao_id", F.explode(T.cited_numbers(F.col("trecho"))).alias("numero"))


def span_context(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "goldenset").select("linha_id", *V.TEXT_KEYS, "inicio", "fim")
    d = table(spark, sf, "documents").select(*V.TEXT_KEYS, "text")
    return g.join(d, V.TEXT_KEYS).select("linha_id", T.context(F.col("text"), F.col("inicio"), F.col("fim")).alias("contexto"))


def document_header(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lower(T.strip_accents(F.substring("text", 1, T.HEADER_PREFIX))).alias("cabecalho"))


# ------------------------------------------------------------------ corpus and resolution


def corpus_sumulas(spark: SparkSession, sf: str) -> DataFrame:
    return R.sumulas(V.corpus(spark, sf))


def corpus_statutes(spark: SparkSession, sf: str) -> DataFrame:
    return R.statutes(V.corpus(spark, sf))


def ruling_index(spark: SparkSession, sf: str) -> DataFrame:
    return R.rulings(V.corpus(spark, sf))


def resolve_sumula(spark: SparkSession, sf: str) -> DataFrame:
    c = V.citations(spark, sf).where(R.route(F.col("trecho")) == "sumula")
    return R.resolve_sumula(c, R.sumulas(V.corpus(spark, sf)), ["citacao_id"])


def resolve_lei(spark: SparkSession, sf: str) -> DataFrame:
    c = V.citations(spark, sf).where(R.route(F.col("trecho")) == "lei")
    return R.resolve_statute(c, R.statutes(V.corpus(spark, sf)), ["citacao_id"])


def _contexts(spark: SparkSession, sf: str):
    return V.contexts(table(spark, sf, "documents"), V.TEXT_KEYS)


def _rulings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.citations(spark, sf).where(R.route(F.col("trecho")) == "acordao"), R.rulings(V.corpus(spark, sf))


def resolve_acordao(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_ruling(*_rulings(spark, sf), ["citacao_id"], _contexts(spark, sf))


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cited, index = _rulings(spark, sf)
    return R.ruling_hits(R.numbered(cited, ["citacao_id"], _contexts(spark, sf)), index, ["citacao_id"]), index


def _ties(spark: SparkSession, sf: str) -> DataFrame:
    return R.ruling_ties(*_hits(spark, sf), ["citacao_id"], _contexts(spark, sf), every=True)


def tiebreak_length(spark: SparkSession, sf: str) -> DataFrame:
    several = R.ruling_lengths(_hits(spark, sf)[0], ["citacao_id"]).where("varios")
    return several.select("citacao_id", "menor", "maior", F.when(R.same_case(), F.col("mais_longo")).alias("id_canonico"))


def tiebreak_header(spark: SparkSession, sf: str) -> DataFrame:
    return _ties(spark, sf).select("citacao_id", "pontos", F.when((F.col("pontos") > 0) & (F.col("n_pontos") == 1), F.col("por_cabecalho")).alias("id_canonico"))


def tiebreak_reporter(spark: SparkSession, sf: str) -> DataFrame:
    return _ties(spark, sf).select("citacao_id", "n_relator", F.when(F.col("n_relator") == 1, F.col("por_relator")).alias("id_canonico"))


def resolve_router(spark: SparkSession, sf: str) -> DataFrame:
    return R.strategy("regex", V.corpus(spark, sf))(V.citations(spark, sf), ["citacao_id"], _contexts(spark, sf))


def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).groupBy(R.route(F.col("trecho")).alias("rota")).agg(F.count(F.lit(1)).alias("n"))


def no_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve(V.citations(spark, sf), None, ["citacao_id"])


_TYPE = f"CASE WHEN regexp_matches(coalesce(trecho, ''), '{ws(T.LAW_TYPE)}', 'i') THEN 'lei' ELSE 'jurisprudencia' END"
_SEEN = f"regexp_matches(coalesce(trecho, ''), '{T.SUMULA_SEEN}', 'i')"
_ROUTE = f"CASE WHEN {_TYPE} = 'lei' THEN 'lei' WHEN {_SEEN} THEN 'sumula' ELSE 'acordao' END"
_SUMULAS = f"sumulas AS (SELECT * FROM (SELECT id, {Z(X('texto', T.SUMULA_IN_CORPUS))} AS numero, nullif(upper(coalesce(tribunal, '')), '') AS tribunal, regexp_matches(texto, 'vinculante', 'i') AS vinculante FROM corpus WHERE natureza = 'sumula') WHERE numero IS NOT NULL)"
_STATUTES = f"statutes AS (SELECT id, numero, {corpus_code_sql('b')} AS diploma FROM (SELECT id, {Z(X('texto', T.ARTICLE_IN_CORPUS))} AS numero, {B(f'substring(texto, 1, {T.DIPLOMA_PREFIX})')} AS b FROM corpus WHERE natureza = 'dispositivo') WHERE numero IS NOT NULL)"
_DATES = rf"regexp_replace(substring(texto, 1, {T.NUMBER_PREFIX}), '{T.DATE}', ' ', 'g')"
_RULINGS = f"""rulings AS (SELECT unnest(CASE WHEN tribunal = 'TST' THEN labour WHEN tribunal = 'STJ' THEN others[1:2] ELSE others[1:1] END) AS numero, id, relator, texto_len, lower({A(f'substring(texto, 1, {T.HEADER_PREFIX})')}) AS cabecalho FROM (SELECT * EXCLUDE (o, l), list_filter(o, lambda x, i: list_position(o, x) = i) AS others, list_filter(l, lambda x, i: list_position(l, x) = i) AS labour FROM (
  SELECT *, list_transform(list_concat(regexp_extract_all(substring(texto, 1, {T.TST_PREFIX}), '{T.CNJ}')[1:1], regexp_extract_all(regexp_extract(texto, '(?i){T.PROCESS_ANCHOR}', 0), '{T.CNJ}')[1:1]), lambda x: {D('x')}) AS l,
    list_filter(list_transform(regexp_extract_all({_DATES}, '{T.HEADER_BLOCK}'), lambda x: {D('x')}), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^(19|20)[0-9][0-9]$')) AS o FROM corpus WHERE natureza = 'acordao')))"""


def _verdict(n: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN 'inventada' WHEN {n} = 1 THEN 'real' ELSE 'incompleta' END"


_RESOLVE_SUMULA = f"""WITH {V.CORPUS_SQL}, {_SUMULAS},
c AS (SELECT citacao_id, {_SUMULA} AS numero, {_BINDING} AS vinculante, {_COURT} AS tribunal FROM extract_citacoes WHERE {_ROUTE} = 'sumula'),
n AS (SELECT c.*, count(DISTINCT s.id) AS n, min(s.id) AS id FROM c LEFT JOIN sumulas s ON s.numero = c.numero AND s.vinculante = c.vinculante AND (c.tribunal IS NULL OR s.tribunal = c.tribunal) GROUP BY ALL)
SELECT citacao_id, CASE WHEN numero IS NULL THEN 'incompleta' ELSE {_verdict('n')} END AS classificacao, CASE WHEN numero IS NOT NULL AND n = 1 THEN id END AS id_canonico FROM n"""
_RESOLVE_LEI = f"""WITH {V.CORPUS_SQL}, {_STATUTES},
c AS (SELECT citacao_id, {_ARTICLE} AS numero, {_code_expr} AS diploma FROM ({_code_src.replace("@src", f"(SELECT citacao_id, trecho FROM extract_citacoes WHERE {_ROUTE} = 'lei')")})),
n AS (SELECT c.*, count(DISTINCT s.id) AS n, min(s.id) AS id FROM c LEFT JOIN statutes s ON s.numero = c.numero AND s.diploma = c.diploma GROUP BY ALL)
SELECT citacao_id, CASE WHEN numero IS NULL OR diploma IS NULL THEN 'incompleta' ELSE {_verdict('n')} END AS classificacao, CASE WHEN n = 1 THEN id END AS id_canonico FROM n"""

# The pattern of cited numbers looks ahead. Scanner letters before a digit, a separator or the end become
# marks first, so that the rest of the pattern needs no lookahead.
_MARKS = "".join(chr(0x2460 + k) for k in range(len(T.OCR_LETTERS)))
_marked = rf"regexp_replace(coalesce(trecho, ''), '{T.DATE}', ' ', 'g')"
for _letter, _mark in zip(T.OCR_LETTERS, _MARKS):
    _marked = rf"regexp_replace({_marked}, '{_letter}((?:[\d.\-/]|{WS})|$)', '{_mark}\1', 'g')"
_FOUND = rf"regexp_extract_all({_marked}, '[0-9](?:[\d.\-/{_MARKS}]|{WS})*[0-9{_MARKS}]')"
_NUMBERS = f"""list_filter(list_transform({_FOUND}, lambda x: {D(f"translate(x, '{_MARKS}', '{T.OCR_DIGITS}')")}), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^(19|20)[0-9][0-9]$'))"""
_CITED = f"""cited AS (SELECT citacao_id, documento_id, parte, inicio, fim, list_filter(o, lambda x, i: list_position(o, x) = i) AS numeros FROM (SELECT *, {_NUMBERS} AS o FROM extract_citacoes WHERE {{where}}))"""
_WORDS = "list_distinct(regexp_extract_all({0}, '[a-z]{{4,}}'))".format
_FEATURES = f"""WITH {V.CORPUS_SQL}, {_RULINGS}, {_CITED.replace("{where}", f"{_ROUTE} = 'acordao'")},
ctx AS (SELECT c.*, lower({A("coalesce(substring(d.text, greatest(0, c.inicio - 250) + 1, c.fim + 250 - greatest(0, c.inicio - 250)), '')")}) AS ctx FROM cited c LEFT JOIN documents d USING (documento_id, parte)),
nums AS (SELECT citacao_id, ctx, unnest(numeros) AS numero FROM ctx),
hits AS (SELECT DISTINCT citacao_id, ctx, r.id, r.texto_len, r.cabecalho, r.relator FROM nums JOIN rulings r USING (numero)),
cand AS (SELECT citacao_id, id, texto_len, len(list_intersect({_WORDS("ctx")}, {_WORDS("cabecalho")})) AS pontos,
  len(list_filter(regexp_split_to_array(lower({A("relator")}), '{WS}+'), lambda p: length(p) > 3 AND p NOT IN ({", ".join(f"'{t}'" for t in R.TITLES)}) AND contains(ctx, p))) > 0 AS citado FROM hits),
top AS (SELECT *, max(pontos) OVER (PARTITION BY citacao_id) AS top FROM cand),
feat AS (SELECT citacao_id, count(*) AS n, min(id) AS um, min(texto_len) AS menor, max(texto_len) AS maior, arg_max(id, {{'l': texto_len, 'i': id::BIGINT}}) AS mais_longo, max(pontos) AS pontos,
  count(*) FILTER (pontos = top) AS n_pontos, max(id) FILTER (pontos = top) AS por_cabecalho, count(*) FILTER (citado) AS n_relator, max(id) FILTER (citado) AS por_relator FROM top GROUP BY citacao_id)"""
_SAME = f"maior > 0 AND menor >= maior * {R.SAME_LENGTH}::DOUBLE"
_RULED = f"""ruled AS (SELECT c.citacao_id, CASE WHEN len(numeros) = 0 THEN NULL WHEN n = 1 THEN um WHEN {_SAME} THEN mais_longo WHEN pontos > 0 AND n_pontos = 1 THEN por_cabecalho WHEN n_relator = 1 THEN por_relator END AS id_canonico,
  len(numeros) = 0 AS nada, n FROM cited c LEFT JOIN feat f USING (citacao_id)),
ruling_out AS (SELECT citacao_id, CASE WHEN nada THEN 'incompleta' WHEN n IS NULL THEN 'inventada' WHEN id_canonico IS NOT NULL THEN 'real' ELSE 'incompleta' END AS classificacao, id_canonico FROM ruled)"""

QUERIES = {
    "strip_accents": scalar(sem_acento=T.strip_accents),
    "base_form": scalar(base=T.base_form),
    "digits_only": scalar(digitos=T.digits_only),
    "strip_dates": scalar(sem_datas=T.strip_dates),
    "ocr_repair": scalar(reparado=T.repair_digits),
    "useful_number": scalar(digitos=T.digits_only, util=lambda c: T.useful_number(T.digits_only(c))),
    "tipo_de": scalar(tipo=T.citation_type),
    "sumula_parse": scalar(reconhece=T.sumula_seen, numero=T.cited_sumula, vinculante=T.is_binding, tribunal=T.cited_court),
    "header_words": scalar(palavras=lambda c: F.array_join(T.long_words(T.base_form(c)), " ")),
    "checksum": scalar(semente=T.checksum),
    "norm_ids": norm_ids,
    "id_lists": id_lists,
    "lei_diploma": article_and_code,
    "case_numbers": cited_numbers,
    "span_context": span_context,
    "document_header": document_header,
    "corpus_sumulas": corpus_sumulas,
    "corpus_diploma": corpus_statutes,
    "ruling_index": ruling_index,
    "resolve_sumula": resolve_sumula,
    "resolve_lei": resolve_lei,
    "resolve_acordao": resolve_acordao,
    "tiebreak_length": tiebreak_length,
    "tiebreak_header": tiebreak_header,
    "tiebreak_reporter": tiebreak_reporter,
    "resolve_router": resolve_router,
    "route_counts": route_counts,
    "no_corpus": no_corpus,
}
ORACLE = {
    "strip_accents": scalar_sql(sem_acento=A("trecho")),
    "base_form": scalar_sql(base=B("trecho")),
    "digits_only": scalar_sql(digitos=D("trecho")),
    "strip_dates": scalar_sql(sem_datas=rf"regexp_replace(trecho, '{T.DATE}', ' ', 'g')"),
    "ocr_repair": scalar_sql(reparado=f"translate(trecho, '{T.OCR_LETTERS}', '{T.OCR_DIGITS}')"),
    "useful_number": scalar_sql(digitos=D("trecho"), util=f"length({D('trecho')}) >= 4 AND NOT regexp_matches({D('trecho')}, '^(19|20)[0-9][0-9]$')"),
    "tipo_de": scalar_sql(tipo=f"CASE WHEN regexp_matches(trecho, '{ws(T.LAW_TYPE)}', 'i') THEN 'lei' ELSE 'jurisprudencia' END"),
    "sumula_parse": scalar_sql(reconhece=f"regexp_matches(trecho, '{T.SUMULA_SEEN}', 'i')", numero=_SUMULA, vinculante=_BINDING, tribunal=_COURT),
    "header_words": f"SELECT citacao_id, array_to_string(list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(w, s.x) = s.i), lambda s: s.x), ' ') AS palavras FROM (SELECT citacao_id, regexp_extract_all({B('trecho')}, '[a-z]{{4,}}') AS w FROM extract_citacoes)",
    # sums of the bytes: a is one more than their sum, b the sum of all a on the way
    "checksum": """WITH b AS (SELECT citacao_id, trecho IS NULL AS none, list_transform(regexp_extract_all(hex(trecho), '..'), lambda h: ('0x' || h)::BIGINT) AS l FROM extract_citacoes)
      SELECT citacao_id, CASE WHEN none THEN NULL ELSE (((coalesce(list_sum(list_transform(l, lambda x, i: x * (len(l) - i + 1))), 0) + len(l)) % 65521 * 65536 + (1 + coalesce(list_sum(l), 0)) % 65521) % 10000)::BIGINT END AS semente FROM b""",
    "norm_ids": f"SELECT citacao_id, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN {Z('t')} ELSE t END AS id_normal FROM (SELECT citacao_id, trim(resolucao.id_canonico) AS t FROM extract_citacoes)",
    "id_lists": f"SELECT linha_id, len(l)::INT AS n, array_to_string(l, '|') AS ids FROM (SELECT linha_id, list_filter(regexp_split_to_array(coalesce(id_canonico, ''), '(?:{WS}|:)+'), lambda x: x <> '' AND x <> '-') AS l FROM goldenset)",
    "lei_diploma": f"SELECT citacao_id, {_ARTICLE} AS artigo, {_code_expr} AS diploma FROM ({_code_src.replace("@src", "extract_citacoes")})",
    "span_context": "SELECT linha_id, substring(text, greatest(0, inicio - 250) + 1, fim + 250 - greatest(0, inicio - 250)) AS contexto FROM goldenset JOIN documents USING (documento_id, parte)",
    "document_header": f"SELECT doc_id, lower({A(f'substring(text, 1, {T.HEADER_PREFIX})')}) AS cabecalho FROM documents",
    "corpus_sumulas": f"WITH {V.CORPUS_SQL}, {_SUMULAS} SELECT * FROM sumulas",
    "corpus_diploma": f"WITH {V.CORPUS_SQL}, {_STATUTES} SELECT * FROM statutes",
    "ruling_index": f"WITH {V.CORPUS_SQL}, {_RULINGS} SELECT * FROM rulings",
    "resolve_sumula": _RESOLVE_SUMULA,
    "resolve_lei": _RESOLVE_LEI,
    "route_counts": f"SELECT {_ROUTE} AS rota, count(*) AS n FROM extract_citacoes GROUP BY ALL",
    "case_numbers": f"WITH {_CITED.replace('{where}', 'true')} SELECT citacao_id, unnest(numeros) AS numero FROM cited",
    "resolve_acordao": f"{_FEATURES}, {_RULED} SELECT * FROM ruling_out",
    "tiebreak_length": f"{_FEATURES} SELECT citacao_id, menor, maior, CASE WHEN {_SAME} THEN mais_longo END AS id_canonico FROM feat WHERE n > 1",
    "tiebreak_header": f"{_FEATURES} SELECT citacao_id, pontos, CASE WHEN pontos > 0 AND n_pontos = 1 THEN por_cabecalho END AS id_canonico FROM feat WHERE n > 1",
    "tiebreak_reporter": f"{_FEATURES} SELECT citacao_id, n_relator, CASE WHEN n_relator = 1 THEN por_relator END AS id_canonico FROM feat WHERE n > 1",
    "resolve_router": f"{_FEATURES}, {_RULED}, done AS (SELECT * FROM ruling_out UNION ALL SELECT * FROM ({_RESOLVE_SUMULA}) UNION ALL SELECT * FROM ({_RESOLVE_LEI})) SELECT citacao_id, {_TYPE} AS tipo, d.classificacao, d.id_canonico FROM done d JOIN extract_citacoes USING (citacao_id)",
    "no_corpus": f"SELECT citacao_id, {_TYPE} AS tipo, CASE WHEN classificacao = 'real' THEN 'incompleta' ELSE classificacao END AS classificacao, NULL::VARCHAR AS id_canonico FROM extract_citacoes",
}
