"""Resolution of citations against a corpus of súmulas, statute articles and rulings.

A citation is `real` if it names exactly one entry, `inventada` if it is well formed and
names none, `incompleta` if it names no number or more than one entry. Nulls: a null text
is `incompleta`.

The text of a citation is parsed once. Súmulas and statutes are looked up in tables with
one row a key, by left joins that keep the citations in place. Of rulings a number may
have several; they are brought together by the citation's key with partial aggregates
(one shuffle of keys, ids and lengths). Only where several rulings stay is more read: their
headers, and the document around the citation. A lookup is broadcast if Spark's estimate
from the files' sizes is under MAX_LOOKUP_BYTES, else shuffled; no job runs for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citaria.functions import text as T

#: Estimated bytes of a lookup table that may be broadcast.
MAX_LOOKUP_BYTES = 16 << 20
#: Titles that don't identify a reporter; share of the longest text that makes candidates the same case.
TITLES = ["min", "ministro", "ministra", "des", "desembargador", "relator"]
SAME_LENGTH = 0.98


def small(df: DataFrame, bound: int = MAX_LOOKUP_BYTES) -> DataFrame:
    """Broadcast hint where the estimated size is within the bound."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= bound else df


def sumulas(corpus: DataFrame) -> DataFrame:
    """(id, numero, tribunal, vinculante) of the corpus rows with a number."""
    rows = corpus.where("natureza = 'sumula'")
    court = F.nullif(F.upper(F.coalesce("tribunal", F.lit(""))), F.lit(""))
    return rows.select("id", T.corpus_sumula(F.col("texto")).alias("numero"), court.alias("tribunal"), T.is_binding(F.col("texto")).alias("vinculante")).where("numero is not null")


def statutes(corpus: DataFrame) -> DataFrame:
    """(id, numero, diploma) of the corpus rows with an article number."""
    rows = corpus.where("natureza = 'dispositivo'")
    return rows.select("id", T.corpus_article(F.col("texto")).alias("numero"), T.corpus_code(F.col("texto")).alias("diploma")).where("numero is not null")


def rulings(corpus: DataFrame) -> DataFrame:
    """(numero, id, relator, texto_len, cabecalho): one row a case number of a ruling's header."""
    rows = corpus.where("natureza = 'acordao'")
    head = F.lower(T.strip_accents(F.substring("texto", 1, T.HEADER_PREFIX)))
    made = rows.select("id", F.coalesce("relator", F.lit("")).alias("relator"), F.coalesce(F.nullif(F.col("texto_len"), F.lit(0)), F.length("texto")).alias("texto_len"), head.alias("cabecalho"), F.explode(T.header_numbers(F.coalesce("tribunal", F.lit("")), F.col("texto"))).alias("numero"))
    return made.select("numero", "id", "relator", "texto_len", "cabecalho")


def by_count(n: Column, one: Column) -> Column:
    """Class and id for a number of distinct entries."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, verdict("inventada")).when(n == 1, verdict("real", one)).otherwise(verdict("incompleta"))


def verdict(kind: str, id_: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("classificacao"), (F.lit(None).cast("string") if id_ is None else id_).alias("id_canonico"))


def _finish(df: DataFrame, keys: list[str], v: Column) -> DataFrame:
    return df.select(*keys, v.alias("_v")).select(*keys, F.col("_v.classificacao").alias("classificacao"), F.col("_v.id_canonico").alias("id_canonico"))


def _counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))


def with_sumulas(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """_n, _id (any court), _n1, _id1 (own court): entries of the citation's (_sumula, _vinculante[, _tribunal])."""
    any_court = _counted(entries, "numero", "vinculante").toDF("_sumula", "_vinculante", "_n", "_id")
    own_court = _counted(entries.where("tribunal is not null"), "numero", "vinculante", "tribunal").toDF("_sumula", "_vinculante", "_tribunal", "_n1", "_id1")
    return parsed.join(small(any_court), ["_sumula", "_vinculante"], "left").join(small(own_court), ["_sumula", "_vinculante", "_tribunal"], "left")


def with_statutes(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """_n2, _id2: entries of the citation's (_artigo, _diploma)."""
    return parsed.join(small(_counted(entries.where("diploma is not null"), "numero", "diploma").toDF("_artigo", "_diploma", "_n2", "_id2")), ["_artigo", "_diploma"], "left")


def sumula_verdict() -> Column:
    return F.when(F.col("_sumula").isNull(), verdict("incompleta")).when(F.col("_tribunal").isNotNull(), by_count(F.col("_n1"), F.col("_id1"))).otherwise(by_count(F.col("_n"), F.col("_id")))


def statute_verdict() -> Column:
    return F.when(F.col("_artigo").isNull() | F.col("_diploma").isNull(), verdict("incompleta")).otherwise(by_count(F.col("_n2"), F.col("_id2")))


def _sumula_parts(c: Column) -> list[Column]:
    return [T.cited_sumula(c).alias("_sumula"), T.is_binding(c).alias("_vinculante"), T.cited_court(c).alias("_tribunal")]


def _statute_parts(c: Column) -> list[Column]:
    return [T.cited_article(c).alias("_artigo"), T.cited_code(c).alias("_diploma")]


def resolve_sumula(citations: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., classificacao, id_canonico). A court that is named must match; without one any court does."""
    return _finish(with_sumulas(citations.select(*keys, *_sumula_parts(F.col("trecho"))), entries), keys, sumula_verdict())


def resolve_statute(citations: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    return _finish(with_statutes(citations.select(*keys, *_statute_parts(F.col("trecho"))), entries), keys, statute_verdict())


def reporter_named(reporter: Column, context: Column) -> Column:
    """Whether a part of the reporter's name of more than three letters, no title, stands in the context."""
    parts = F.filter(F.split(F.lower(T.strip_accents(reporter)), r"(?U)\s+"), lambda p: (F.length(p) > 3) & ~p.isin(TITLES))
    return F.exists(parts, lambda p: context.contains(p))


def numbered(citations: DataFrame, keys: list[str], contexts: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(keys..., _numeros, and the columns that `contexts` names in its attribute `needs`, else contexto)."""
    needs = ["contexto"] if contexts is None else getattr(contexts, "needs", [])
    more = [c for c in needs if c not in keys]
    return citations.select(*keys, *more, T.cited_numbers(F.coalesce("trecho", F.lit(""))).alias("_numeros"))


def ruling_hits(numbers: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., id, texto_len, ...): rulings of the numbers (_numeros) of each citation; a null row for a number without any."""
    rows = numbers.withColumn("numero", F.explode("_numeros")).drop("_numeros")
    return rows.join(small(index.select("numero", "id", "texto_len")), "numero", "left").drop("numero")


def ruling_lengths(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row a citation: um (the smallest id), varios, menor, maior, mais_longo. All are partial aggregates that repeats don't change."""
    order = F.struct("texto_len", F.col("id").try_cast("bigint"), "id")
    return hits.groupBy(*keys).agg(F.min("id").alias("um"), (F.max("id") > F.min("id")).alias("varios"), F.min("texto_len").alias("menor"), F.max("texto_len").alias("maior"), F.max_by("id", order).alias("mais_longo"))


def ruling_ties(hits: DataFrame, index: DataFrame, keys: list[str], contexts: Callable[[DataFrame], DataFrame] | None, every: bool = False) -> DataFrame:
    """(keys..., pontos, n_pontos, por_cabecalho, n_relator, por_relator) of the citations with several rulings that their lengths don't decide.

    pontos: words that a candidate's header shares with the context. contexts gives citations their
    column contexto; None: they have it. every: those that lengths decide too.
    """
    own = Window.partitionBy(*keys)
    bounds = {"_um": F.min("id"), "_outro": F.max("id"), "menor": F.min("texto_len"), "maior": F.max("texto_len")}
    open_ = hits.withColumns({n: c.over(own) for n, c in bounds.items()}).where(F.col("id").isNotNull() & (F.col("_outro") > F.col("_um")))
    if not every:
        open_ = open_.where(~F.coalesce(same_case(), F.lit(False)))
    rows = open_.drop(*bounds, "texto_len").dropDuplicates([*keys, "id"])
    heads = index.select("id", "relator", "cabecalho").dropDuplicates(["id"])
    pairs = (rows if contexts is None else contexts(rows)).select(*keys, "id", F.lower(T.strip_accents(F.coalesce("contexto", F.lit("")))).alias("_ctx")).join(small(heads), "id")
    points = F.size(F.array_intersect(T.long_words(F.col("_ctx")), T.long_words(F.col("cabecalho"))))
    scored = pairs.select(*keys, "id", points.alias("pontos"), reporter_named(F.col("relator"), F.col("_ctx")).alias("citado"))
    best = scored.withColumn("_top", F.max("pontos").over(own))
    return best.groupBy(*keys).agg(
        F.max("pontos").alias("pontos"),
        F.count_if(F.col("pontos") == F.col("_top")).alias("n_pontos"),
        F.max_by("id", "pontos").alias("por_cabecalho"),
        F.count_if("citado").alias("n_relator"),
        F.max(F.when(F.col("citado"), F.col("id"))).alias("por_relator"),
    )


def same_case() -> Column:
    return (F.col("maior") > 0) & (F.col("menor") >= F.col("maior") * F.lit(SAME_LENGTH))


def resolve_numbered(numbers: DataFrame, index: DataFrame, keys: list[str], contexts: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(keys..., _v) of ruling citations with numbers (see `numbered`)."""
    hits = ruling_hits(numbers, index, keys)
    all_ = ruling_lengths(hits, keys).join(ruling_ties(hits, index, keys, contexts), keys, "left")
    v = (
        F.when(F.col("um").isNull(), verdict("inventada"))
        .when(~F.col("varios"), verdict("real", F.col("um")))
        .when(same_case(), verdict("real", F.col("mais_longo")))
        .when((F.col("pontos") > 0) & (F.col("n_pontos") == 1), verdict("real", F.col("por_cabecalho")))
        .when(F.col("n_relator") == 1, verdict("real", F.col("por_relator")))
        .otherwise(verdict("incompleta"))
    )
    return all_.select(*keys, v.alias("_v"))


def resolve_ruling(citations: DataFrame, index: DataFrame, keys: list[str], contexts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One candidate is it; of several of one length, the longest; else the only best header; else the only reporter named."""
    parsed = numbered(citations, keys, contexts)
    none = parsed.where(F.size("_numeros") == 0).select(*keys, verdict("incompleta").alias("_v"))
    some = resolve_numbered(parsed.where(F.size("_numeros") > 0), index, keys, contexts)
    return _finish(none.unionByName(some), keys, F.col("_v"))


def route(c: Column) -> Column:
    """Statutes first, then súmulas, then rulings."""
    c = F.coalesce(c, F.lit(""))
    return F.when(T.citation_type(c) == "lei", "lei").when(T.sumula_seen(c), "sumula").otherwise("acordao")


def resolve(citations: DataFrame, corpus: DataFrame | None, keys: list[str], contexts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys..., tipo, classificacao, id_canonico) of citations (keys, trecho, contexto[, classificacao]).

    keys identify a citation: of ruling citations with equal keys the numbers are taken together.
    contexts: gives the few citations that need it their column contexto, from the columns that
    its attribute `needs` names; None if all have it. Other columns are ignored, whatever their names.
    Without a corpus nothing can be real: `real` becomes `incompleta`, and ids are cleared.
    """
    text = F.coalesce("trecho", F.lit(""))
    if corpus is None:
        kept = F.when(F.col("classificacao") == "real", "incompleta").otherwise(F.col("classificacao"))
        return citations.select(*keys, T.citation_type(text).alias("tipo"), kept.alias("classificacao"), F.lit(None).cast("string").alias("id_canonico"))
    routed = citations.select(*keys, text.alias("_t"), route(F.col("trecho")).alias("_route"))
    own = lambda kind, c: F.when(F.col("_route") == kind, c)
    parts = [(F.when(F.col("_route") == kind, F.struct(*made(F.col("_t"))))).alias(f"_{kind}") for kind, made in (("sumula", _sumula_parts), ("lei", _statute_parts))]
    parsed = routed.select(*keys, "_route", *parts, own("acordao", T.cited_numbers(F.col("_t"))).alias("_numeros"))
    tipo = F.when(F.col("_route") == "lei", "lei").otherwise("jurisprudencia").alias("tipo")
    in_place = parsed.where(F.coalesce(F.size("_numeros"), F.lit(0)) <= 0).select(*keys, "_route", tipo, "_sumula.*", "_lei.*")
    looked = with_statutes(with_sumulas(in_place, sumulas(corpus)), statutes(corpus))
    v = F.when(F.col("_route") == "lei", statute_verdict()).when(F.col("_route") == "sumula", sumula_verdict()).otherwise(verdict("incompleta"))
    of_rulings = numbered(citations.where(route(F.col("trecho")) == "acordao"), keys, contexts).where(F.size("_numeros") > 0)
    rulings_ = resolve_numbered(of_rulings, rulings(corpus), keys, contexts)
    done = looked.select(*keys, "tipo", v.alias("_v")).unionByName(rulings_.select(*keys, F.lit("jurisprudencia").alias("tipo"), "_v"))
    return done.select(*keys, "tipo", "_v.classificacao", "_v.id_canonico")


STRATEGIES = {"regex": resolve}


def strategy(name: str, corpus: DataFrame | None = None) -> Callable[..., DataFrame]:
    """The resolver of a name, for a corpus (null: nothing can be real); names are trimmed and case doesn't matter."""
    try:
        chosen = STRATEGIES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown strategy: {name}") from None
    return chosen if corpus is None else lambda citations, keys, contexts=None: chosen(citations, corpus, keys, contexts)
