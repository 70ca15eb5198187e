"""The tables as the operators take them: golden set, predictions, corpus, chat examples.

Each view has the SQL that gives the same rows, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaria.functions import chat
from citaria.functions import text as T
from citaria.operators.score import GOLD_FIELDS, PRED_FIELDS, gathered, numbered
from citaria.session import scanned, table

TEXT_KEYS = ["documento_id", "parte"]
RUN_KEYS = ["run", "documento_id", "parte"]
#: Runs up to which they are broadcast to the golden set.
MAX_RUNS = 10_000
SYSTEM = "Marque com <start> e <end> cada fonte jurídica citada e devolva o texto sem outra mudança."
#: The corpus has labels only; these phrases stand for the articles' wording, by which the corpus rules tell codes apart.
WORDING = {
    "Código Civil": "ato ilícito",
    "Código de Processo Civil": "o ônus da prova incumbe ao autor",
    "Código de Processo Penal": "a prisão preventiva poderá ser decretada",
    "Código de Defesa do Consumidor": "o fornecedor responde perante o consumidor",
    "Constituição Federal": "nos termos desta Constituição",
    "Código Eleitoral": "compete aos tribunais eleitorais",
    "Consolidação das Leis do Trabalho": "no contrato de trabalho",
    "Código Penal Militar": "contra a administração militar",
    "Lei das Inelegibilidades": "são inelegíveis para qualquer cargo",
}


def golden_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(documento_id, parte, gold): the distinct valid golden spans of each text (inicio, fim, nivel, classe, ids), in order."""
    g = table(spark, sf, "goldenset").where("inicio >= 0 and fim > inicio and documento_id is not null and parte is not null")
    ids = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("id_canonico", F.lit("")), F.lit("([0-9]+)"), F.lit(1)), T.norm_id))
    g = g.select(*TEXT_KEYS, "nivel", "inicio", "fim", F.lower(F.trim("classificacao")).alias("classe"), ids.alias("ids"), "linha_id")
    return gathered(g, TEXT_KEYS, ["inicio", "fim", "linha_id"], ["inicio", "fim", "nivel", "classe", "ids", "linha_id"], "gold")


def golden(spark: SparkSession, sf: str) -> DataFrame:
    """(documento_id, parte, gi, inicio, fim, nivel, classe, ids, linha_id): distinct valid spans of the golden set, numbered a text."""
    return numbered(golden_texts(spark, sf), TEXT_KEYS, "gold", "gi")


GOLDEN_SQL = r"""
golden_rows AS (SELECT *, row_number() OVER (PARTITION BY documento_id, parte, inicio, fim ORDER BY linha_id) AS rn FROM goldenset
  WHERE inicio >= 0 AND fim > inicio AND documento_id IS NOT NULL AND parte IS NOT NULL),
golden AS (SELECT documento_id, parte, nivel, inicio, fim, lower(trim(classificacao)) AS classe, linha_id,
  list_distinct(list_transform(regexp_extract_all(coalesce(id_canonico, ''), '([0-9]+)', 1), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)) AS ids,
  row_number() OVER (PARTITION BY documento_id, parte ORDER BY inicio, fim) - 1 AS gi FROM golden_rows WHERE rn = 1)
"""


def prediction_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(run, documento_id, parte, pred): the predicted spans of each text of a run as given, retries dropped, in order."""
    e = table(spark, sf, "extract_citacoes").where("inicio >= 0 and fim > inicio and run is not null and documento_id is not null and parte is not null")
    kind = F.lower(F.trim("classificacao"))
    id_ = F.when(kind == "real", T.norm_id(F.col("resolucao.id_canonico")))
    p = e.select(*RUN_KEYS, "citacao_id", "inicio", "fim", kind.alias("classe"), id_.alias("id_canonico"), "confianca")
    return gathered(p, RUN_KEYS, ["inicio", "fim", "citacao_id"], ["inicio", "fim", "classe", "id_canonico", "confianca", "citacao_id"], "pred")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(run, documento_id, parte, pi, inicio, fim, classe, id_canonico, confianca, citacao_id) of all runs."""
    return numbered(prediction_texts(spark, sf), RUN_KEYS, "pred", "pi")


PRED_SQL = r"""
pred_rows AS (SELECT *, row_number() OVER (PARTITION BY run, documento_id, parte, inicio, fim ORDER BY citacao_id) AS rn FROM extract_citacoes
  WHERE inicio >= 0 AND fim > inicio AND run IS NOT NULL AND documento_id IS NOT NULL AND parte IS NOT NULL),
pred_first AS (SELECT run, documento_id, parte, citacao_id, inicio, fim, lower(trim(classificacao)) AS classe, trim(resolucao.id_canonico) AS id0, confianca FROM pred_rows WHERE rn = 1),
pred AS (SELECT run, documento_id, parte, citacao_id, inicio, fim, classe, confianca,
  CASE WHEN classe = 'real' THEN CASE WHEN regexp_matches(id0, '^[0-9]+$') THEN CASE WHEN ltrim(id0, '0') = '' THEN '0' ELSE ltrim(id0, '0') END ELSE id0 END END AS id_canonico,
  row_number() OVER (PARTITION BY run, documento_id, parte ORDER BY inicio, fim, citacao_id) - 1 AS pi FROM pred_first)
"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """(run): the runs that are known or have rows, those that returned nothing included."""
    named = table(spark, sf, "execucoes").select("run").unionByName(table(spark, sf, "extract_citacoes").select("run"))
    return named.where("run is not null").distinct()


def by_run(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Every row for every run. The runs are a short list that goes along as a literal; more than MAX_RUNS are a product, as the result is one."""
    each = runs.select("run").where("run is not null").distinct()
    few = [r.run for r in each.limit(MAX_RUNS + 1).collect()]
    if len(few) > MAX_RUNS:
        return each.crossJoin(texts)
    return texts.withColumn("run", F.explode(F.array(*map(F.lit, few)) if few else F.array().cast("array<string>")))


def golden_by_run(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Every golden row for every run: texts that a run returned nothing for are scored too."""
    return by_run(gold, runs).select(*RUN_KEYS, "nivel", "gi", "inicio", "fim", "classe", "ids")


def scored_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(run, documento_id, parte, gold, pred) of every golden text for every run; each table is read once (and once for the names of its runs)."""
    named = lambda name, number, fields: F.transform(name, lambda x, i: F.struct(i.alias(number), *(x[c].alias(c) for c in fields))).alias(name)
    gold = golden_texts(spark, sf).select(*TEXT_KEYS, named("gold", "gi", GOLD_FIELDS[1:]))
    pred = prediction_texts(spark, sf).select(*RUN_KEYS, named("pred", "pi", PRED_FIELDS[1:]))
    return by_run(gold, runs(spark, sf)).join(pred, RUN_KEYS, "left")


SCORED_SQL = (
    "WITH "
    + GOLDEN_SQL
    + ","
    + PRED_SQL
    + r""",
gold AS (SELECT r.run, g.* FROM golden g CROSS JOIN (SELECT run FROM execucoes WHERE run IS NOT NULL UNION SELECT run FROM extract_citacoes WHERE run IS NOT NULL) r),
cand AS (SELECT g.run, g.documento_id, g.parte, g.gi, p.pi, least(g.fim, p.fim) - greatest(g.inicio, p.inicio) AS i, (g.fim - g.inicio) + (p.fim - p.inicio) AS w
  FROM gold g JOIN pred p USING (run, documento_id, parte) WHERE least(g.fim, p.fim) > greatest(g.inicio, p.inicio)),
cand2 AS (SELECT *, i::DOUBLE / (w - i)::DOUBLE AS iou FROM cand WHERE 2 * i >= w - i),
lists AS (SELECT run, documento_id, parte, list_reduce(list([{'gi': gi, 'pi': pi}] ORDER BY -iou, gi, pi),
  lambda a, b: CASE WHEN len(list_filter(a, lambda z: z.gi = b[1].gi OR z.pi = b[1].pi)) > 0 THEN a ELSE list_concat(a, b) END) AS l FROM cand2 GROUP BY run, documento_id, parte),
taken AS (SELECT run, documento_id, parte, unnest(l) AS t FROM lists),
pairs AS (SELECT run, documento_id, parte, t.gi AS gi, t.pi AS pi FROM taken),
marked AS (SELECT g.*, q.pi FROM gold g LEFT JOIN pairs q USING (run, documento_id, parte, gi)),
levels AS (SELECT run, documento_id, parte, max(nivel) AS nivel FROM gold GROUP BY ALL),
loose AS (SELECT p.*, l.nivel FROM pred p JOIN levels l USING (run, documento_id, parte) WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.run = p.run AND q.documento_id = p.documento_id AND q.parte = p.parte AND q.pi = p.pi)),
ev AS (SELECT m.run, m.documento_id, m.parte, m.nivel, 'par' AS caso, m.classe AS classe_g, p.classe AS classe_p,
    CASE WHEN m.classe = p.classe AND (m.classe <> 'real' OR coalesce(list_contains(m.ids, p.id_canonico), false)) THEN 1 ELSE 0 END AS acerto, p.confianca
    FROM marked m JOIN pred p USING (run, documento_id, parte, pi) WHERE m.pi IS NOT NULL
  UNION ALL SELECT run, documento_id, parte, nivel, 'perdida', classe, NULL, 0, NULL FROM marked WHERE pi IS NULL
  UNION ALL SELECT run, documento_id, parte, nivel, CASE WHEN EXISTS (SELECT 1 FROM marked m WHERE m.pi IS NOT NULL AND m.run = l.run AND m.documento_id = l.documento_id AND m.parte = l.parte
      AND 10 * greatest(0, least(m.fim, l.fim) - greatest(m.inicio, l.inicio)) >= 9 * (l.fim - l.inicio)) THEN 'extra' ELSE 'espuria' END, NULL, classe, 0, NULL FROM loose l),
conf AS (SELECT run, nivel, classe, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(suporte)::BIGINT AS suporte FROM (
  SELECT run, nivel, classe_g AS classe, (caso = 'par' AND acerto = 1)::INT AS tp, 0 AS fp, (caso = 'perdida' OR (caso = 'par' AND classe_g IS DISTINCT FROM classe_p))::INT AS fn, 1 AS suporte FROM ev WHERE classe_g IS NOT NULL
  UNION ALL SELECT run, nivel, classe_p, 0, (caso = 'espuria' OR (caso = 'par' AND acerto = 0))::INT, 0, 0 FROM ev WHERE classe_p IS NOT NULL) GROUP BY ALL),
f1s AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN (2.0 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM conf WHERE suporte > 0),
macro AS (SELECT run, nivel, avg(f1) AS macro_f1, max(f1) FILTER (classe = 'real') AS f1_real, max(f1) FILTER (classe = 'inventada') AS f1_inventada, max(f1) FILTER (classe = 'incompleta') AS f1_incompleta FROM f1s GROUP BY ALL),
taus AS (SELECT run, nivel, count(*) FILTER (caso = 'par' AND classe_g = 'inventada' AND classe_p = 'real') AS graves, count(*) FILTER (classe_g = 'inventada') AS inventadas FROM ev GROUP BY ALL),
briers AS (SELECT run, nivel, count(*) FILTER (caso = 'par' AND confianca IS NOT NULL) AS n_conf, avg(pow(confianca - acerto, 2)) FILTER (caso = 'par' AND confianca IS NOT NULL) AS brier FROM ev GROUP BY ALL),
scores AS (SELECT run, nivel, macro_f1, f1_real, f1_inventada, f1_incompleta, CASE WHEN inventadas > 0 THEN graves::DOUBLE / inventadas ELSE 0 END AS tau,
  coalesce(greatest(0::DOUBLE, least(0.1::DOUBLE, 0.1::DOUBLE * (1 - brier))), 0) AS b FROM macro JOIN taus USING (run, nivel) JOIN briers USING (run, nivel)),
final AS (SELECT *, macro_f1 * (1 - 0.5::DOUBLE * tau) AS s, macro_f1 * (1 - 0.5::DOUBLE * tau) * (1 + b) AS score FROM scores)
"""
)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(id, natureza, tribunal, relator, texto, texto_len): the reference list as a corpus of texts.

    Rulings whose id is 1 modulo 3 are there twice, under another id and of another
    length and reporter, so that ties have to be broken.
    """
    c = table(spark, sf, "canonicos").where("id_canonico is not null and rotulo is not null")
    wording = F.lit("")
    for code, phrase in WORDING.items():
        wording = F.when(F.col("rotulo").endswith(code), phrase).otherwise(wording)
    base = c.select(F.col("id_canonico").alias("id"), "natureza", "tribunal", F.lit("Min. Hermínio Jurandel").alias("relator"), F.concat("rotulo", F.lit(". "), F.coalesce("descricao", F.lit("")), F.lit(". "), wording).alias("texto"))
    again = base.where((F.col("natureza") == "acordao") & (F.col("id").cast("bigint") % 3 == 1))
    twin = again.select(F.concat("id", F.lit("1")).alias("id"), "natureza", "tribunal", F.lit("Min. Celvina Cordovaz").alias("relator"), F.concat("texto", F.when(F.col("id").cast("bigint") % 2 == 0, " Apelação militar no mérito, com voto vencido.").otherwise(".")).alias("texto"))
    return base.unionByName(twin).withColumn("texto_len", F.length("texto"))


_wording_sql = "''"
for _code, _phrase in WORDING.items():
    _wording_sql = f"CASE WHEN suffix(rotulo, '{_code}') THEN '{_phrase}' ELSE {_wording_sql} END"
CORPUS_SQL = f"""
corpus_base AS (SELECT id_canonico AS id, natureza, tribunal, 'Min. Hermínio Jurandel' AS relator, rotulo || '. ' || coalesce(descricao, '') || '. ' || {_wording_sql} AS texto
  FROM canonicos WHERE id_canonico IS NOT NULL AND rotulo IS NOT NULL),
corpus AS (SELECT *, length(texto) AS texto_len FROM (SELECT * FROM corpus_base
  UNION ALL SELECT id || '1', natureza, tribunal, 'Min. Celvina Cordovaz', texto || CASE WHEN id::BIGINT % 2 = 0 THEN ' Apelação militar no mérito, com voto vencido.' ELSE '.' END
  FROM corpus_base WHERE natureza = 'acordao' AND id::BIGINT % 3 = 1))
"""


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """(citacao_id, documento_id, parte, inicio, fim, trecho, classificacao)."""
    return table(spark, sf, "extract_citacoes").select("citacao_id", *TEXT_KEYS, "inicio", "fim", "trecho", "classificacao")


def contexts(docs: DataFrame, keys: list[str], text: str = "text"):
    """Gives citations (keys, inicio, fim) the text around their span (contexto), by a join with their documents."""
    own = docs.select(*keys, F.col(text).alias("_text"))

    def joined(rows: DataFrame) -> DataFrame:
        ctx = T.context(F.col("_text"), F.col("inicio"), F.col("fim"))
        return rows.join(own, keys, "left").withColumn("contexto", F.coalesce(ctx, F.lit(""))).drop("_text")

    joined.needs = [*keys, "inicio", "fim"]
    return joined


def examples(spark: SparkSession, sf: str, name: str = "prata") -> DataFrame:
    """(key, texto, raw): the text of a chat example and its marked answer."""
    key = "exemplo_id" if name == "prata" else "documento_id"
    m = F.col("messages")
    return scanned(spark, sf, name).select(key, chat.after_first_line(chat.of_role(m, "user")).alias("texto"), chat.of_role(m, "assistant").alias("raw"))
