"""Queries of windows, spans, tags, training examples and augmentation, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaria.functions import chat, spans
from citaria.functions import text as T
from citaria.operators import augment, extract, resolve, tags, train_data, windows
from citaria.plans import text_queries
from citaria.plans import views as V
from citaria.plans.text_queries import WS
from citaria.session import scanned, shared_checkpoints, ship_package, table
from citaria.sources import files

SMALL_BUDGET, SMALL_OVERLAP = 300, 40
SPAN = "struct<inicio:int,fim:int>"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return scanned(spark, sf, "documents")


def _windows(spark: SparkSession, sf: str, budget: int, overlap: int, keys=("doc_id",)) -> DataFrame:
    return windows.windows(_docs(spark, sf), list(keys), "text", budget, overlap)


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, windows.DEFAULT_BUDGET, windows.DEFAULT_OVERLAP).select("doc_id", "janela", "inicio", "fim")


def chunk_small_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, SMALL_BUDGET, SMALL_OVERLAP).select("doc_id", "janela", "inicio", "fim", "texto")


def window_edge_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Golden spans in the windows that hold them, and whether they reach into an overlap."""
    w = _windows(spark, sf, SMALL_BUDGET, SMALL_OVERLAP, V.TEXT_KEYS).withColumnsRenamed({"inicio": "w0", "fim": "w1"})
    g = V.golden(spark, sf).select(*V.TEXT_KEYS, "gi", "inicio", "fim")
    j = w.join(g, V.TEXT_KEYS).where("inicio >= w0 and fim <= w1")
    flag = windows.at_edge(F.col("inicio"), F.col("fim"), F.col("w0"), F.col("w1"), F.col("n_texto"), SMALL_OVERLAP)
    return j.select(*V.TEXT_KEYS, "janela", F.col("gi").cast("bigint").alias("gi"), flag.alias("borda"))


def _located(spark: SparkSession, sf: str, needle) -> DataFrame:
    e = table(spark, sf, "extract_citacoes").select("citacao_id", *V.TEXT_KEYS, needle.alias("agulha")).where("agulha is not null")
    d = _docs(spark, sf).select(*V.TEXT_KEYS, "text").where("text is not null")
    j = e.join(d, V.TEXT_KEYS).select("citacao_id", tags.locate(F.col("text"), F.col("agulha")).alias("s"))
    return j.select("citacao_id", "s.inicio", "s.fim")


def span_locate(spark: SparkSession, sf: str) -> DataFrame:
    return _located(spark, sf, F.col("trecho"))


def span_locate_ws(spark: SparkSession, sf: str) -> DataFrame:
    """Needles whose spaces became line ends: only found where white space may differ."""
    return _located(spark, sf, F.concat(F.lit(" "), F.replace(F.col("trecho"), F.lit(" "), F.lit("\n  "))))


def tag_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = V.examples(spark, sf, "prata").where("texto is not null and raw is not null")
    s = e.select("exemplo_id", F.posexplode_outer(tags.tag_spans(F.col("texto"), F.col("raw"))).alias("posicao", "s")).where("posicao is not null")
    return s.select("exemplo_id", "posicao", "s.inicio", "s.fim")


def nms_window(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted spans of a text of a run, greedily suppressed by position."""
    l = spans.keep_first(F.transform("pred", lambda x: F.struct(x["inicio"].alias("inicio"), x["fim"].alias("fim"))), SPAN, by_position=True)  # noqa: E741
    return V.prediction_texts(spark, sf).select(*V.RUN_KEYS, F.explode(l).alias("s")).select(*V.RUN_KEYS, "s.inicio", "s.fim")


def nms_document(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted spans as the windows of their document show them, once for each window; spans inside a window win over those at its edge."""
    w = _windows(spark, sf, SMALL_BUDGET, SMALL_OVERLAP, V.TEXT_KEYS).select(*V.TEXT_KEYS, F.col("inicio").alias("w0"), F.col("fim").alias("w1"), "n_texto")
    p = V.predictions(spark, sf).select(*V.RUN_KEYS, "inicio", "fim")
    flag = windows.at_edge(F.col("inicio"), F.col("fim"), F.col("w0"), F.col("w1"), F.col("n_texto"), SMALL_OVERLAP)
    seen = p.join(w, V.TEXT_KEYS).where("inicio >= w0 and fim <= w1").select(*V.RUN_KEYS, F.struct(flag.alias("borda"), "inicio", "fim").alias("s"))
    rows = seen.groupBy(*V.RUN_KEYS).agg(spans.keep_first(F.array_sort(F.collect_list("s")), "struct<borda:boolean,inicio:int,fim:int>").alias("l"))
    return rows.select(*V.RUN_KEYS, F.explode("l").alias("s")).select(*V.RUN_KEYS, "s.borda", "s.inicio", "s.fim")


def valid_spans(spark: SparkSession, sf: str) -> DataFrame:
    p = V.predictions(spark, sf).groupBy(*V.RUN_KEYS).agg(F.array_sort(F.collect_list(F.struct("inicio", "fim"))).alias("l"))
    d = _docs(spark, sf).select(*V.TEXT_KEYS, F.length("text").alias("n"))
    j = p.join(d, V.TEXT_KEYS).select(*V.RUN_KEYS, F.explode_outer(spans.disjoint(F.col("l"), F.col("n"))).alias("s")).where("s is not null")
    return j.select(*V.RUN_KEYS, "s.inicio", "s.fim")


def _golden_lists(spark: SparkSession, sf: str) -> DataFrame:
    """(documento_id, parte, texto, spans) of the golden texts."""
    g = V.golden(spark, sf).groupBy(*V.TEXT_KEYS).agg(F.array_sort(F.collect_list(F.struct("inicio", "fim"))).alias("spans"))
    d = _docs(spark, sf).select(*V.TEXT_KEYS, F.col("text").alias("texto")).where("text is not null")
    return d.join(g, V.TEXT_KEYS)


def mark_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _golden_lists(spark, sf).select(*V.TEXT_KEYS, spans.mark(F.col("texto"), F.col("spans")).alias("marcado"))


def segments_map(spark: SparkSession, sf: str) -> DataFrame:
    s = _golden_lists(spark, sf).select(*V.TEXT_KEYS, F.posexplode(spans.segments(F.col("texto"), F.col("spans"))).alias("k", "s"))
    return s.select(*V.TEXT_KEYS, "k", "s.tipo", "s.trecho")


def roundtrip_accept(spark: SparkSession, sf: str) -> DataFrame:
    g = _golden_lists(spark, sf)
    return g.select(*V.TEXT_KEYS, F.size("spans").alias("n"), tags.accepted_mark(F.col("texto"), F.col("spans")).isNotNull().alias("aceita"))


def silver_examples(spark: SparkSession, sf: str) -> DataFrame:
    blocked = table(spark, sf, "goldenset")
    docs = train_data.without(_docs(spark, sf), blocked, "documento_id")
    w = windows.windows(docs, V.TEXT_KEYS, "text")
    return train_data.silver_examples(w, V.predictions(spark, sf).select(*V.TEXT_KEYS, "inicio", "fim"), V.TEXT_KEYS, V.SYSTEM)


def silver_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The silver examples with a column a message."""
    content = [F.col("messages")[k]["content"].alias(name) for k, name in enumerate(("sistema", "usuario", "resposta"))]
    return silver_examples(spark, sf).select(*V.TEXT_KEYS, "inicio", "n_spans", *content)


def end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, windows, a rule model's marks, spans (kept as a table, as the extraction of a run is), resolution: one row a citation."""
    docs = _docs(spark, sf).where("text is not null")
    shared_checkpoints(spark)
    keys = ["doc_id", "inicio", "fim", "trecho"]
    cited = extract.extract(docs, ["doc_id"], "text", extract.rule_marked).select("doc_id", F.inline("citacoes")).select(*keys).checkpoint()
    return resolve.resolve(cited, V.corpus(spark, sf), keys, V.contexts(docs, ["doc_id"]))


def prompt_messages(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "janela").where("text is not null")
    m = j.select("janela_id", F.explode(chat.prompt(V.SYSTEM, F.col("documento_id"), F.col("text"))).alias("m"))
    return m.select("janela_id", "m.role", "m.content")


# ------------------------------------------------------------------ training data


def heldout_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return train_data.without(_docs(spark, sf), table(spark, sf, "goldenset"), "documento_id").select("doc_id")


def eval_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "goldenset").select("documento_id").distinct()


def manifest_origins(spark: SparkSession, sf: str) -> DataFrame:
    return files.manifest_origins(table(spark, sf, "prata").select(F.concat(F.lit("data/train/"), F.col("documento_id"), F.lit(".txt")).alias("origem")))


def gold_spans(spark: SparkSession, sf: str) -> DataFrame:
    g = V.golden(spark, sf).groupBy(*V.TEXT_KEYS).agg(F.array_sort(F.collect_list(F.struct("inicio", "fim"))).alias("l"))
    return g.select(*V.TEXT_KEYS, F.array_join(F.transform("l", lambda s: F.concat_ws("-", s["inicio"].cast("string"), s["fim"].cast("string"))), " ").alias("spans"))


def limpar_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = V.examples(spark, sf, "gemma").where("raw is not null").select("documento_id", train_data.cleaned(F.col("raw")).alias("c"))
    return e.select("documento_id", F.col("c").isNotNull().alias("aceito"), F.length("c.plano").alias("n"))


def sample_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents to make variants of; the sample is the feature."""
    return augment.sampled(_docs(spark, sf).select("doc_id"), "doc_id", 5)


def request_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each document, by its number."""
    return augment.requests(None, spark, 1, _docs(spark, sf).select(F.col("doc_id").alias("indice")))


def retry_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that are tried again until they are accepted (here by a draw), with the round and its temperature."""

    def attempt(left: DataFrame, k: int) -> DataFrame:
        lucky = (augment.draw(3, F.col("indice"), k, "aceito") > 0) | F.lit(k == 4)
        return left.where(lucky).select("indice", F.lit(k).alias("rodada"), F.lit(augment.temperature(k)).alias("temperatura"))

    return augment.until_accepted(_docs(spark, sf).select(F.col("doc_id").alias("indice")), attempt)


class CourtMarker:
    """A model for `model_marks`: marks the short names of courts."""

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        return [None if t is None else re.sub(r"(?a)\b(STF|STJ|TST|TSE|STM)\b", r"<start>\1<end>", t) for t in texts]


def model_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows marked by a batched callable in Python workers."""
    ship_package(spark)
    rows = table(spark, sf, "janela").select("janela_id", F.col("text").alias("texto"))
    return extract.model_marked(rows, CourtMarker).select("janela_id", "raw")


def label_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Label masks over white-space tokens (a token's id is its length here): sizes, and tokens to learn."""
    e = V.examples(spark, sf, "prata").where("texto is not null and raw is not null")
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+\s*|\s+)"), F.lit(1))
    e = e.select("exemplo_id", words(F.col("texto")).alias("p"), words(F.col("raw")).alias("r"), F.length("texto").alias("at"))
    ids = F.transform(F.concat("p", "r"), F.length)
    starts = F.concat(F.transform("p", lambda _: F.lit(0)), F.transform("r", lambda _: F.col("at")))
    e = e.select("exemplo_id", train_data.masked(ids, starts, F.col("at")).alias("m"))
    e = e.select("exemplo_id", F.explode_outer(F.array("m")).alias("m")).where("m is not null")
    return e.select("exemplo_id", F.size("m.input_ids").alias("n"), F.size(F.filter("m.labels", lambda x: x != train_data.IGNORED)).alias("n_aprender"))


def _variant(operation: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return augment.variants(_golden_lists(spark, sf), V.TEXT_KEYS, operations=(operation,)).select(*V.TEXT_KEYS, "variante", "perdidas")

    return query


def augment_variants(spark: SparkSession, sf: str) -> DataFrame:
    return augment.variants(_golden_lists(spark, sf), V.TEXT_KEYS)


#: Names of the queries of single operations.
VARIANTS = {"synonym": "sinonimos", "noise": "ocr", "insert": "insere", "drop": "remove_frase", "names": "troca_nomes", "protocol": "troca_protocolo", "reorder": "reordena", "dates": "troca_data", "closing": "expande", "combined": "combina"}
QUERIES = {
    "chunk_windows": chunk_windows,
    "chunk_small_budget": chunk_small_budget,
    "window_edge_flag": window_edge_flag,
    "span_locate": span_locate,
    "span_locate_ws": span_locate_ws,
    "tag_parse": tag_parse,
    "nms_window": nms_window,
    "nms_document": nms_document,
    "valid_spans": valid_spans,
    "mark_spans": mark_spans,
    "segments_map": segments_map,
    "roundtrip_accept": roundtrip_accept,
    "silver_examples": silver_examples,
    "silver_rows": silver_rows,
    "end_to_end": end_to_end,
    "prompt_messages": prompt_messages,
    "heldout_antijoin": heldout_antijoin,
    "eval_ids": eval_ids,
    "manifest_origins": manifest_origins,
    "gold_spans": gold_spans,
    "limpar_filter": limpar_filter,
    "sample_sources": sample_sources,
    "request_prompts": request_prompts,
    "retry_rounds": retry_rounds,
    "model_marks": model_marks,
    "label_mask": label_mask,
    **{f"augment_{name}": _variant(op) for name, op in VARIANTS.items()},
    "augment_variants": augment_variants,
}


def _windows_sql(budget: int, overlap: int, keys: str) -> str:
    def last(sep: str) -> str:
        return f"CASE WHEN contains(p, {sep}) THEN length(regexp_extract(p, '(?s)^(.*)' || {sep}, 1)) ELSE -1 END"

    cut = f"""CASE WHEN e >= n THEN n WHEN {last("chr(10) || chr(10)")} >= m THEN a + {last("chr(10) || chr(10)")} WHEN {last("chr(10)")} >= m THEN a + {last("chr(10)")} WHEN {last("' '")} >= m THEN a + {last("' '")} ELSE e END"""
    step = f"(SELECT *, substring(text, a + 1, e - a) AS p, greatest({overlap + 1}, (e - a) // 2) AS m FROM (SELECT *, least(a + {budget}, n) AS e FROM {{0}}))"
    first = step.format(f"(SELECT {keys}, text, length(text) AS n, 0 AS k, 0 AS a FROM documents WHERE text IS NOT NULL)")
    more = step.format(f"(SELECT {keys}, text, n, k + 1 AS k, greatest(fim - {overlap}, a + 1) AS a FROM win WHERE fim < n)")
    return f"win AS (SELECT {keys}, text, n, k, a, {cut} AS fim FROM {first} UNION ALL SELECT {keys}, text, n, k, a, {cut} FROM {more})"


def _pred_lists(rows: str, with_: str = "WITH") -> str:
    return f"""{with_} {V.PRED_SQL}, l AS ({rows}),
kept AS (SELECT run, documento_id, parte, list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda z: least(z.fim, b[1].fim) > greatest(z.inicio, b[1].inicio)
  AND 3 * (least(z.fim, b[1].fim) - greatest(z.inicio, b[1].inicio)) >= (z.fim - z.inicio) + (b[1].fim - b[1].inicio))) > 0 THEN a ELSE list_concat(a, b) END) AS l FROM l),
s AS (SELECT run, documento_id, parte, unnest(l) AS s FROM kept) """


_LOOSE = rf"""WITH e AS (SELECT citacao_id, documento_id, parte, {{needle}} AS a FROM extract_citacoes WHERE trecho IS NOT NULL),
j AS (SELECT citacao_id, text, regexp_replace(a, '^\n+|\n+$', '', 'g') AS a FROM e JOIN documents USING (documento_id, parte) WHERE text IS NOT NULL),
w AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(a, '{WS}+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '{WS}+') AS p, strpos(text, a) AS pos FROM j),
r AS (SELECT *, CASE WHEN pos = 0 AND p <> '' THEN regexp_extract(text, '(?s)^(.*?)(' || p || ')', 1) END AS h, CASE WHEN pos = 0 AND p <> '' THEN regexp_extract(text, '(?s)^(.*?)(' || p || ')', 2) END AS f FROM w)
SELECT citacao_id, CASE WHEN a = '' THEN NULL WHEN pos > 0 THEN pos - 1 WHEN length(f) > 0 THEN length(h) END AS inicio, CASE WHEN a = '' THEN NULL WHEN pos > 0 THEN pos - 1 + length(a) WHEN length(f) > 0 THEN length(h) + length(f) END AS fim FROM r"""
_NEEDLE = "list_filter(list_transform(regexp_extract_all(raw, '(?is)<start\\b[^>]*>(.*?)<end>', 1), lambda x: regexp_replace(x, '^\\n+|\\n+$', '', 'g')), lambda x: x <> '')"
_WS_PATTERN = f"array_to_string(list_transform(list_filter(regexp_split_to_array(n, '{WS}+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '{WS}+')"
#: The cursor as a recursion over the tags: ahead exactly, ahead loosely, from the start exactly, from the start loosely.
def _walk(keys: str) -> str:
    return f"""walk AS (SELECT {keys}, t, l, 0 AS k, 0::BIGINT AS c, NULL::BIGINT AS a, NULL::BIGINT AS b FROM ex
  UNION ALL SELECT {keys}, t, l, k + 1, coalesce(b, c), a, b FROM (SELECT *, a + CASE WHEN pa > 0 OR (length(fa) = 0 AND pf > 0) THEN length(n) WHEN length(fa) > 0 THEN length(fa) ELSE length(ff) END AS b FROM (
    SELECT *, CASE WHEN pa > 0 THEN c + pa - 1 WHEN length(fa) > 0 THEN c + length(ha) WHEN pf > 0 THEN pf - 1 WHEN length(ff) > 0 THEN length(hf) END AS a FROM (
    SELECT *, CASE WHEN p = '' THEN '' ELSE regexp_extract(r, '(?s)^(.*?)(' || p || ')', 1) END AS ha, CASE WHEN p = '' THEN '' ELSE regexp_extract(r, '(?s)^(.*?)(' || p || ')', 2) END AS fa,
      CASE WHEN p = '' THEN '' ELSE regexp_extract(t, '(?s)^(.*?)(' || p || ')', 1) END AS hf, CASE WHEN p = '' THEN '' ELSE regexp_extract(t, '(?s)^(.*?)(' || p || ')', 2) END AS ff FROM (
    SELECT *, strpos(r, n) AS pa, strpos(t, n) AS pf, {_WS_PATTERN} AS p FROM (SELECT {keys}, t, l, k, c, l[k + 1] AS n, substring(t, c + 1) AS r FROM walk WHERE k < len(l))))))),
lists AS (SELECT {keys}, list([{{'inicio': a, 'fim': b}}] ORDER BY a, b) AS l FROM walk WHERE a IS NOT NULL GROUP BY {keys}),
kept AS (SELECT {keys}, list_reduce(l, lambda x, y: CASE WHEN len(list_filter(x, lambda z: least(z.fim, y[1].fim) > greatest(z.inicio, y[1].inicio)
  AND 3 * (least(z.fim, y[1].fim) - greatest(z.inicio, y[1].inicio)) >= (z.fim - z.inicio) + (y[1].fim - y[1].inicio))) > 0 THEN x ELSE list_concat(x, y) END) AS l FROM lists)"""


_TAGS = f"""WITH RECURSIVE msg AS (SELECT exemplo_id, list_filter(messages, lambda m: m.role = 'user' AND m.content IS NOT NULL)[1].content AS u, list_filter(messages, lambda m: m.role = 'assistant' AND m.content IS NOT NULL)[1].content AS raw FROM prata),
ex AS (SELECT exemplo_id, CASE WHEN strpos(u, chr(10)) > 0 THEN substring(u, strpos(u, chr(10)) + 1) ELSE '' END AS t, {_NEEDLE} AS l FROM msg WHERE u IS NOT NULL AND raw IS NOT NULL),
{_walk("exemplo_id")}
SELECT exemplo_id, posicao::INT AS posicao, s.inicio::INT AS inicio, s.fim::INT AS fim FROM (SELECT exemplo_id, unnest(l) AS s, unnest(range(len(l))) AS posicao FROM kept)"""
#: The windows are whole texts here; a text may hold tags of its own, so that needles come from the marked text.
_ROUND_TRIP = f"""WITH RECURSIVE {V.GOLDEN_SQL}, own AS (SELECT g.documento_id, g.parte, g.gi, g.inicio, g.fim, d.text FROM golden g JOIN documents d USING (documento_id, parte) WHERE text IS NOT NULL),
inside AS (SELECT *, coalesce(lag(fim) OVER (PARTITION BY documento_id, parte ORDER BY gi), 0) AS prev FROM own WHERE fim <= length(text)),
marks AS (SELECT documento_id, parte, string_agg(substring(text, prev + 1, inicio - prev) || '<start>' || substring(text, inicio + 1, fim - inicio) || '<end>', '' ORDER BY gi) AS m, max(fim) AS last, list({{'inicio': inicio::BIGINT, 'fim': fim::BIGINT}} ORDER BY gi) AS l FROM inside GROUP BY documento_id, parte),
texts AS (SELECT documento_id, parte, any_value(text) AS t, count(*)::INT AS n FROM own GROUP BY documento_id, parte),
raws AS (SELECT x.*, coalesce(m, '') || substring(t, coalesce(last, 0) + 1) AS raw, coalesce(l, []) AS w FROM texts x LEFT JOIN marks USING (documento_id, parte)),
ex AS (SELECT documento_id, parte, t, {_NEEDLE} AS l FROM raws),
{_walk("documento_id, parte")}
SELECT documento_id, parte, n, coalesce(k.l, []) = w AS aceita FROM raws LEFT JOIN kept k USING (documento_id, parte)"""
#: Windows of documents outside the golden set, the spans inside them, marks, and the spans that the marks give back.
_SILVER = f"""WITH RECURSIVE {_windows_sql(windows.DEFAULT_BUDGET, windows.DEFAULT_OVERLAP, 'documento_id, parte')}, {V.PRED_SQL},
w AS (SELECT documento_id, parte, a AS w0, fim AS w1, substring(text, a + 1, fim - a) AS t FROM win v WHERE NOT EXISTS (SELECT 1 FROM goldenset g WHERE g.documento_id = v.documento_id)),
ins AS (SELECT DISTINCT w.documento_id, w.parte, w0, p.inicio - w0 AS a, p.fim - w0 AS b FROM w JOIN pred p ON p.documento_id = w.documento_id AND p.parte = w.parte AND p.inicio >= w0 AND p.fim <= w1),
own AS (SELECT documento_id, parte, w0, count(*)::INT AS n, list_reduce(list([{{'inicio': a::BIGINT, 'fim': b::BIGINT}}] ORDER BY a, b), lambda x, y: CASE WHEN y[1].inicio < x[-1].fim THEN x ELSE list_concat(x, y) END) AS s FROM ins GROUP BY documento_id, parte, w0),
flat AS (SELECT documento_id, parte, w0, unnest(s) AS s FROM own),
cut AS (SELECT f.documento_id, f.parte, f.w0, s.inicio AS a, s.fim AS b, t, coalesce(lag(s.fim) OVER (PARTITION BY f.documento_id, f.parte, f.w0 ORDER BY s.inicio), 0) AS prev FROM flat f JOIN w ON w.documento_id = f.documento_id AND w.parte = f.parte AND w.w0 = f.w0),
marks AS (SELECT documento_id, parte, w0, string_agg(substring(t, prev + 1, a - prev) || '<start>' || substring(t, a + 1, b - a) || '<end>', '' ORDER BY a) AS m, max(b) AS last FROM cut GROUP BY documento_id, parte, w0),
raws AS (SELECT documento_id, parte, w0, t, coalesce(n, 0) AS n, coalesce(s, []) AS s, coalesce(m, '') || substring(t, coalesce(last, 0) + 1) AS raw FROM w LEFT JOIN own USING (documento_id, parte, w0) LEFT JOIN marks USING (documento_id, parte, w0)),
ex AS (SELECT documento_id, parte, w0, t, {_NEEDLE} AS l FROM raws),
{_walk("documento_id, parte, w0")}
SELECT documento_id, parte, w0::INT AS inicio, n::INT AS n_spans, '{V.SYSTEM}' AS sistema, 'documento_id: ' || documento_id || '#' || parte || chr(10) || chr(10) || t AS usuario, raw AS resposta FROM raws LEFT JOIN kept k USING (documento_id, parte, w0) WHERE coalesce(k.l, []) = s"""
_RULE = extract.RULE.removeprefix("(?iu)").replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''")
#: The resolution's SQL over the citations that the rule model finds, as rows of a document with one section.
_END_TO_END = f"""WITH RECURSIVE {_windows_sql(windows.DEFAULT_BUDGET, windows.DEFAULT_OVERLAP, 'doc_id')},
ex AS (SELECT doc_id, w0, w1, n AS tot, t, {_NEEDLE} AS l FROM (SELECT doc_id, a AS w0, fim AS w1, n, substring(text, a + 1, fim - a) AS t, regexp_replace(substring(text, a + 1, fim - a), '({_RULE})', '<start>\\1<end>', 'gi') AS raw FROM win)),
{_walk("doc_id, w0, w1, tot").replace("kept AS", "in_window AS")},
moved AS (SELECT doc_id, w0, w1, tot, s.inicio + w0 AS a, s.fim + w0 AS b FROM (SELECT doc_id, w0, w1, tot, unnest(l) AS s FROM in_window)),
seen AS (SELECT doc_id, list([{{'inicio': a, 'fim': b}}] ORDER BY (w0 > 0 AND a < w0 + {windows.DEFAULT_OVERLAP}) OR (w1 < tot AND b > w1 - {windows.DEFAULT_OVERLAP}), a, b) AS l FROM moved GROUP BY doc_id),
in_text AS (SELECT doc_id, list_reduce(l, lambda x, y: CASE WHEN len(list_filter(x, lambda z: least(z.fim, y[1].fim) > greatest(z.inicio, y[1].inicio)
  AND 3 * (least(z.fim, y[1].fim) - greatest(z.inicio, y[1].inicio)) >= (z.fim - z.inicio) + (y[1].fim - y[1].inicio))) > 0 THEN x ELSE list_concat(x, y) END) AS l FROM seen),
spans AS (SELECT doc_id, unnest(l) AS s FROM in_text),
cited_rows AS (SELECT row_number() OVER (ORDER BY doc_id, s.inicio, s.fim) AS citacao_id, doc_id AS documento_id, 0 AS parte, s.inicio AS inicio, s.fim AS fim, substring(text, s.inicio + 1, s.fim - s.inicio) AS trecho FROM spans JOIN documents USING (doc_id)),
docs_ AS (SELECT doc_id AS documento_id, 0 AS parte, text FROM documents WHERE text IS NOT NULL),
resolved AS ({text_queries.ORACLE["resolve_router"].replace("extract_citacoes", "cited_rows").replace("documents d USING", "docs_ d USING")})
SELECT documento_id AS doc_id, inicio::INT AS inicio, fim::INT AS fim, trecho, tipo, classificacao, id_canonico FROM resolved JOIN cited_rows USING (citacao_id)"""
_GT = f"WITH {V.GOLDEN_SQL}, gt AS (SELECT g.*, d.text, coalesce(lag(g.fim) OVER (PARTITION BY g.documento_id, g.parte ORDER BY gi), 0) AS prev, max(g.fim) OVER (PARTITION BY g.documento_id, g.parte) AS last FROM golden g JOIN documents d USING (documento_id, parte) WHERE text IS NOT NULL)"
_FREE, _FIXED, _TAIL = "substring(text, prev + 1, inicio - prev)", "substring(text, inicio + 1, fim - inicio)", "substring(any_value(text), any_value(last) + 1)"


def _replaced(x: str) -> str:
    for a, b in augment.SYNONYMS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _pick(values: tuple[str, ...], seed: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][('0x' || substring(md5({seed}), 1, 8))::BIGINT % {len(values)} + 1]"


# ------------------------------------------------------------------ variants, as SQL over the parts of a text
def _draw(n: str, *what: str) -> str:
    return f"('0x' || substring(md5(concat_ws('|', {', '.join(what)})), 1, 8))::BIGINT % ({n})"


def _between(low: int, high: int, *what: str) -> str:
    return f"({low} + {_draw(str(high - low + 1), *what)})::VARCHAR"


def _one_of(values: tuple[str, ...], *what: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{_draw(str(len(values)), *what)} + 1]"


def _each_match(x: str, pattern: str, make) -> str:
    split = f"regexp_split_to_array({x}, '{pattern}')"
    return f"array_to_string(list_transform({split}, lambda p, k: CASE WHEN k < len({split}) THEN p || {make('(k - 1)')} ELSE p END), '')"


def _changed(source: str, value: str) -> str:
    return f"SELECT documento_id, parte, i, tipo, seed, CASE WHEN tipo = 'livre' THEN {value} ELSE t END AS t FROM {source}"


def _chosen_part(source: str, value: str) -> str:
    """value where the part is the one drawn among the free ones of more than 80 characters."""
    at = f"SELECT documento_id, parte, any_value(seed) AS seed, list(i ORDER BY i) AS l FROM {source} WHERE tipo = 'livre' AND length(t) > 80 GROUP BY documento_id, parte"
    drawn = f"SELECT documento_id, parte, l[{_draw('len(l)', 'seed', chr(39) + 'onde' + chr(39))} + 1] AS spot FROM ({at})"
    return f"SELECT s.documento_id, s.parte, i, tipo, seed, CASE WHEN i = spot THEN {value} ELSE t END AS t FROM {source} s LEFT JOIN ({drawn}) c ON c.documento_id = s.documento_id AND c.parte = s.parte"


def _synonyms_of(source: str) -> str:
    return _changed(source, _replaced("t"))


def _inserted(source: str) -> str:
    return _chosen_part(source, f"regexp_replace(t, '{WS}+$', '') || ' ' || {_one_of(augment.SENTENCES, 'seed', chr(39) + 'frase' + chr(39))} || chr(10)")


def _numbers_of(source: str) -> str:
    q = lambda c: f"'{c}'"
    process = " || ".join((_between(1_000_000, 9_999_999, "seed", "i", q("a")), q("-"), _between(10, 99, "seed", "i", q("b")), q("."), _between(2018, 2024, "seed", "i", q("c")), q("."), _between(1, 8, "seed", "i", q("d")), q("."), f"lpad({_between(1, 27, 'seed', 'i', q('e'))}, 2, '0')", q("."), f"lpad({_between(1, 9999, 'seed', 'i', q('f'))}, 4, '0')"))
    a = _changed(source, _each_match("t", augment.PROCESS, lambda _: f"({process})"))
    b = _changed(f"({a})", _each_match("t", augment.SHEETS, lambda k: f"'fls. ' || {_between(100, 900, 'seed', 'i', k, q('g'))} || '/' || {_between(100, 980, 'seed', 'i', k, q('h'))}"))
    return _changed(f"({b})", _each_match("t", augment.AMOUNT, lambda k: f"'R$ ' || {_between(1, 80, 'seed', 'i', k, q('v'))} || '.000,00'"))


def _dates_of(source: str) -> str:
    q = lambda c: f"'{c}'"
    t = "t"
    for name in augment.CITIES_OUT:
        t = f"replace({t}, '{name}', {_one_of(augment.CITIES, 'seed', q('cidade'))})"
    a = _changed(source, t)
    made = lambda k: f"{_between(1, 28, 'seed', 'i', k, q('d'))} || ' de ' || {_one_of(augment.MONTHS, 'seed', 'i', k, q('m'))} || ' de ' || {_between(2020, 2025, 'seed', 'i', k, q('a'))}"
    return _changed(f"({a})", _each_match("t", augment.LONG_DATE.replace("(?iu)", "(?i)"), made))


def _noise_of(source: str) -> str:
    swaps = "".join(f" WHEN '{a}' THEN '{b}' WHEN '{a.upper()}' THEN '{b.upper()}'" for a, b in augment.OCR_SWAPS.items())
    x = "((('0x' || substring(md5(seed), 1, 8))::BIGINT + i * 7919 + (k - 1) * 104729) % 2147483647)"
    hit = f"(({x} * {x} + 12345) % 2147483647) % 10000 < {int(augment.OCR_SHARE * 10_000)}"
    return _changed(source, f"array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c, k: CASE WHEN {hit} THEN CASE c{swaps} ELSE c END ELSE c END), '')")


def _dropped(source: str) -> str:
    split = rf"string_split(regexp_replace(t, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1))"
    own = f"SELECT *, {split} AS l, list_filter(list_transform({split}, lambda s, k: CASE WHEN length(s) > 40 AND length(s) < 180 THEN k END), lambda k: k IS NOT NULL) AS c FROM {source}"
    at = f"c[{_draw('greatest(len(c), 1)', 'seed', 'i', chr(39) + 'frase' + chr(39))} + 1]"
    return _changed(f"({own})", f"CASE WHEN len(c) > 0 THEN array_to_string(list_filter(l, lambda s, k: k <> {at}), ' ') ELSE t END")


def _named(source: str) -> str:
    party = augment.PARTY.replace("'", "''")
    names = f"SELECT documento_id, parte, list_filter(list_transform(regexp_extract_all(string_agg(t, '' ORDER BY i), '{party}', 1), lambda n: trim(n)), lambda n: length(n) > 8) AS found FROM {source} GROUP BY documento_id, parte"
    t = "t"
    for k in range(len(augment.NAMES)):
        new = "[" + ", ".join(f"'{v}'" for v in augment.NAMES) + f"][({_draw(str(len(augment.NAMES)), 'seed', chr(39) + 'nomes' + chr(39))} + {k}) % {len(augment.NAMES)} + 1]"
        t = f"CASE WHEN len(found) > {k} THEN replace({t}, found[{k + 1}], {new}) ELSE {t} END"
    return _changed(f"(SELECT s.*, found FROM {source} s JOIN ({names}) f ON f.documento_id = s.documento_id AND f.parte = s.parte)", t)


_PARTS = {"sinonimos": _synonyms_of, "ocr": _noise_of, "insere": _inserted, "remove_frase": _dropped, "troca_nomes": _named, "troca_protocolo": _numbers_of, "troca_data": _dates_of}


def _variant_sql(op: str) -> str:
    """The variants of one operation: (documento_id, parte, variante, perdidas)."""
    base = f"""{_GT.replace("gt AS (SELECT g.*, d.text,", "gt AS (SELECT g.*, d.text, concat_ws('|', '42', g.documento_id, g.parte, '" + op + "') AS seed,")},
parts AS (SELECT documento_id, parte, 2 * gi AS i, 'livre' AS tipo, seed, {_FREE} AS t FROM gt UNION ALL SELECT documento_id, parte, 2 * gi + 1, 'fixo', seed, {_FIXED} FROM gt
  UNION ALL SELECT documento_id, parte, 2 * count(*), 'livre', any_value(seed), {_TAIL} FROM gt GROUP BY documento_id, parte)"""
    joined = "SELECT documento_id, parte, string_agg(t, '' ORDER BY i) AS variante FROM ({0}) GROUP BY documento_id, parte".format
    if op in _PARTS:
        made = joined(_PARTS[op]("parts"))
    elif op == "combina":
        made = joined(_numbers_of(f"({_inserted('syn')})"))
        base += f", syn AS ({_synonyms_of('parts')})"
    elif op == "expande":
        head, tail = augment.CLOSING.split("{}")
        made = f"SELECT documento_id, parte, any_value(text) || '{head}' || {_one_of(augment.CITIES, 'any_value(seed)', chr(39) + 'fim' + chr(39))} || '{tail}' AS variante FROM gt GROUP BY documento_id, parte"
    else:
        base += """, texts AS (SELECT documento_id, parte, any_value(text) AS text, any_value(seed) AS seed, list({'a': inicio, 'b': fim}) AS spans FROM gt GROUP BY documento_id, parte),
blocks AS (SELECT documento_id, parte, seed, spans, unnest(range(len(l))) AS k, unnest(l) AS t, l FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS l FROM texts)),
placed AS (SELECT documento_id, parte, seed, k, t, len(list_filter(spans, lambda s: s.a < spot + length(t) AND s.b > spot)) = 0 AS free FROM (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY documento_id, parte ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM blocks)),
places AS (SELECT *, row_number() OVER (PARTITION BY documento_id, parte ORDER BY k) AS r FROM placed WHERE free),
order_ AS (SELECT documento_id, parte, t, row_number() OVER (PARTITION BY documento_id, parte ORDER BY md5(concat_ws('|', seed, k)), k) AS r FROM placed WHERE free),
moved AS (SELECT p.documento_id, p.parte, p.k, o.t FROM places p JOIN order_ o USING (documento_id, parte, r) UNION ALL SELECT documento_id, parte, k, t FROM placed WHERE NOT free)"""
        made = "SELECT documento_id, parte, string_agg(t, chr(10) || chr(10) ORDER BY k) AS variante FROM moved GROUP BY documento_id, parte"
    return f"""{base}, made AS ({made})
SELECT m.documento_id, m.parte, m.variante, count(*) FILTER (NOT contains(m.variante, {_FIXED.replace("text", "g.text")}))::INT AS perdidas FROM made m JOIN gt g ON g.documento_id = m.documento_id AND g.parte = m.parte GROUP BY m.documento_id, m.parte, m.variante"""


_SEED = "'42|' || documento_id || '|' || parte"
_I = "indice || '|1|'"
ORACLE = {
    "chunk_windows": f"WITH RECURSIVE {_windows_sql(windows.DEFAULT_BUDGET, windows.DEFAULT_OVERLAP, 'doc_id')} SELECT doc_id, k AS janela, a AS inicio, fim FROM win",
    "chunk_small_budget": f"WITH RECURSIVE {_windows_sql(SMALL_BUDGET, SMALL_OVERLAP, 'doc_id')} SELECT doc_id, k AS janela, a AS inicio, fim, substring(text, a + 1, fim - a) AS texto FROM win",
    "window_edge_flag": f"WITH RECURSIVE {_windows_sql(SMALL_BUDGET, SMALL_OVERLAP, 'documento_id, parte')}, {V.GOLDEN_SQL} SELECT documento_id, parte, k AS janela, gi, (a > 0 AND g.inicio < a + {SMALL_OVERLAP}) OR (w.fim < n AND g.fim > w.fim - {SMALL_OVERLAP}) AS borda FROM win w JOIN golden g USING (documento_id, parte) WHERE g.inicio >= a AND g.fim <= w.fim",
    "span_locate": _LOOSE.replace("{needle}", "trecho"),
    "span_locate_ws": _LOOSE.replace("{needle}", "' ' || replace(trecho, ' ', chr(10) || '  ')"),
    "tag_parse": _TAGS,
    "roundtrip_accept": _ROUND_TRIP,
    "retry_rounds": "SELECT doc_id AS indice, r::INT AS rodada, round(0.7::DOUBLE + 0.1::DOUBLE * r, 6) AS temperatura FROM (SELECT doc_id, CASE "
    + " ".join(f"WHEN {_draw('3', 'doc_id', str(k), chr(39) + 'aceito' + chr(39))} > 0 THEN {k}" for k in (1, 2, 3))
    + " ELSE 4 END AS r FROM documents)",
    "model_marks": r"SELECT janela_id, regexp_replace(text, '\b(STF|STJ|TST|TSE|STM)\b', '<start>\1<end>', 'g') AS raw FROM janela",
    "silver_rows": _SILVER,
    "end_to_end": _END_TO_END,
    "label_mask": r"""WITH msg AS (SELECT exemplo_id, list_filter(messages, lambda m: m.role = 'user' AND m.content IS NOT NULL)[1].content AS u, list_filter(messages, lambda m: m.role = 'assistant' AND m.content IS NOT NULL)[1].content AS raw FROM prata),
      w AS (SELECT exemplo_id, len(regexp_extract_all(CASE WHEN strpos(u, chr(10)) > 0 THEN substring(u, strpos(u, chr(10)) + 1) ELSE '' END, '\S+\s*|\s+')) AS p, len(regexp_extract_all(raw, '\S+\s*|\s+')) AS r FROM msg WHERE u IS NOT NULL AND raw IS NOT NULL)
      SELECT exemplo_id, least(2048, p + r)::INT AS n, least(2048, r)::INT AS n_aprender FROM w WHERE r > 0""",
    "nms_window": _pred_lists("SELECT run, documento_id, parte, list([{'inicio': inicio, 'fim': fim}] ORDER BY inicio, fim) AS l FROM pred GROUP BY run, documento_id, parte") + "SELECT run, documento_id, parte, s.inicio AS inicio, s.fim AS fim FROM s",
    "nms_document": _pred_lists(f"""SELECT run, documento_id, parte, list([{{'borda': borda, 'inicio': inicio, 'fim': fim}}] ORDER BY borda, inicio, fim) AS l FROM (
      SELECT p.run, p.documento_id, p.parte, p.inicio, p.fim, (a > 0 AND p.inicio < a + {SMALL_OVERLAP}) OR (w.fim < n AND p.fim > w.fim - {SMALL_OVERLAP}) AS borda FROM pred p JOIN win w ON w.documento_id = p.documento_id AND w.parte = p.parte AND p.inicio >= a AND p.fim <= w.fim) GROUP BY run, documento_id, parte""",
      f"WITH RECURSIVE {_windows_sql(SMALL_BUDGET, SMALL_OVERLAP, 'documento_id, parte')},") + "SELECT run, documento_id, parte, s.borda AS borda, s.inicio AS inicio, s.fim AS fim FROM s",
    "valid_spans": f"""WITH {V.PRED_SQL}, l AS (SELECT run, documento_id, parte, list([{{'inicio': p.inicio, 'fim': p.fim}}] ORDER BY p.inicio, p.fim) AS l FROM pred p JOIN documents d USING (documento_id, parte) WHERE p.fim <= length(text) GROUP BY run, documento_id, parte),
      kept AS (SELECT run, documento_id, parte, list_reduce(l, lambda a, b: CASE WHEN b[1].inicio < a[-1].fim THEN a ELSE list_concat(a, b) END) AS l FROM l),
      s AS (SELECT run, documento_id, parte, unnest(l) AS s FROM kept) SELECT run, documento_id, parte, s.inicio AS inicio, s.fim AS fim FROM s""",
    "mark_spans": f"{_GT} SELECT documento_id, parte, string_agg({_FREE} || '<start>' || {_FIXED} || '<end>', '' ORDER BY gi) || {_TAIL} AS marcado FROM gt GROUP BY documento_id, parte",
    "segments_map": f"{_GT} SELECT documento_id, parte, (2 * gi)::INT AS k, 'livre' AS tipo, {_FREE} AS trecho FROM gt UNION ALL SELECT documento_id, parte, (2 * gi + 1)::INT, 'fixo', {_FIXED} FROM gt UNION ALL SELECT documento_id, parte, (2 * count(*))::INT, 'livre', {_TAIL} FROM gt GROUP BY documento_id, parte",
    "prompt_messages": f"SELECT janela_id, 'system' AS role, '{V.SYSTEM}' AS content FROM janela WHERE text IS NOT NULL UNION ALL SELECT janela_id, 'user', 'documento_id: ' || documento_id || chr(10) || chr(10) || text FROM janela WHERE text IS NOT NULL",
    "heldout_antijoin": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM goldenset g WHERE g.documento_id = d.documento_id)",
    "eval_ids": "SELECT DISTINCT documento_id FROM goldenset",
    "manifest_origins": "SELECT DISTINCT documento_id FROM prata WHERE documento_id IS NOT NULL",
    "gold_spans": f"WITH {V.GOLDEN_SQL} SELECT documento_id, parte, string_agg(inicio || '-' || fim, ' ' ORDER BY inicio, fim) AS spans FROM golden GROUP BY documento_id, parte",
    "limpar_filter": rf"""WITH r AS (SELECT documento_id, list_filter(messages, lambda m: m.role = 'assistant' AND m.content IS NOT NULL)[1].content AS raw FROM gemma),
      t AS (SELECT documento_id, regexp_replace(regexp_replace(regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g'), '^```[a-zA-Z]*\n?|\n?```$', '', 'g'), '^{WS}+|{WS}+$', '', 'g') AS m FROM r WHERE raw IS NOT NULL),
      p AS (SELECT documento_id, m, regexp_replace(m, '<start>([^<]*)<end>', '\1', 'g') AS plain, len(regexp_extract_all(m, '<start>[^<]*<end>')) AS k FROM t),
      a AS (SELECT documento_id, plain, NOT contains(plain, '<start>') AND NOT contains(plain, '<end>') AND k >= {train_data.MIN_MARKS} AND length(plain) BETWEEN {train_data.MIN_CHARS} AND {train_data.MAX_CHARS} AS ok FROM p)
      SELECT documento_id, ok AS aceito, CASE WHEN ok THEN length(plain) END AS n FROM a""",
    "sample_sources": "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 5",
    "request_prompts": f"SELECT indice, 'Escreva um ' || {_pick(augment.GENRES, _I + chr(32).join(['||']) + chr(39) + 'g' + chr(39))} || ' do ' || {_pick(augment.COURTS, _I + '||' + chr(39) + 't' + chr(39))} || ' sobre ' || {_pick(augment.TOPICS, _I + '||' + chr(39) + 'm' + chr(39))} || '{augment.REQUEST}' || indice || '.' AS pedido FROM (SELECT doc_id AS indice FROM documents)",
    **{f"augment_{name}": _variant_sql(op) for name, op in VARIANTS.items()},
    "augment_variants": " UNION ALL ".join(f"SELECT documento_id, parte, '{op}' AS operacao, variante, perdidas FROM ({_variant_sql(op)})" for op in augment.OPERATIONS),
}
