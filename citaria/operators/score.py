"""Scoring of predicted citations against a golden set, by level.

Spans are aligned one to one by overlap (IoU of a half or more, greedy by the largest,
ties by golden then predicted index), classes and ids are compared, and the counts become
F1 a class, a penalty for invented citations taken for real, and a calibration bonus.

The golden and the predicted spans of a text are two sorted arrays (`gathered`), which one
equality join on the text's key brings together; pairs, misses and spurious predictions
come from folds over the two, and all counts of a level from one conditional aggregation.
An array holds the spans of one section of a document in one run. Defined results: a class without golden citations is left out of the mean; a level
without any is left out; without confidences the bonus is 0; a golden text without
predictions counts as misses; predictions of texts that aren't in the golden set don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citaria.functions.spans import contained, greedy_pairs, iou, same_span
from citaria.functions.text import let
from citaria.operators.codec import CLASSES

#: Penalty weight, bonus ceiling, level weights (1 for any other level).
GAMMA, BONUS, LEVEL_WEIGHTS = 0.5, 0.10, {1: 1.0, 2: 2.0}


#: What the arrays of a text hold, in the order that they are sorted by.
GOLD_FIELDS = ("gi", "inicio", "fim", "nivel", "classe", "ids")
PRED_FIELDS = ("pi", "inicio", "fim", "classe", "id_canonico", "confianca")
EVENT = "array<struct<nivel:int,caso:string,classe_g:string,classe_p:string,acerto:int,confianca:double>>"


def gathered(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """(keys..., name ARRAY<STRUCT<fields>>): the rows of a text in the order given; rows alike in all but the last
    column of the order (retries) are the first of them. One shuffle; duplicates are dropped in the text's own array."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_v")))).alias("_l"))
    before = lambda i: F.get("_l", i - 1)
    first = lambda x, i: (i == 0) | ~F.struct(*(x[c] for c in order[:-1])).eqNullSafe(F.struct(*(before(i)[c] for c in order[:-1])))
    return rows.select(*keys, F.transform(F.filter("_l", first), lambda x: x["_v"]).alias(name))


def numbered(texts: DataFrame, keys: list[str], name: str, number: str) -> DataFrame:
    """The rows of gathered texts again, numbered from 0."""
    return texts.select(*keys, F.posexplode(name).alias(number, "_v")).select(*keys, number, "_v.*")


def span_pairs(gold: Column, pred: Column) -> Column:
    """ARRAY<STRUCT<gi, pi>>: one-to-one pairs of the spans of a text, greedy by overlap."""
    def candidates(g: Column) -> Column:
        near = F.filter(pred, lambda p: same_span(g["inicio"], g["fim"], p["inicio"], p["fim"]))
        return F.transform(near, lambda p: F.struct((-iou(g["inicio"], g["fim"], p["inicio"], p["fim"])).alias("o"), g["gi"].alias("gi"), p["pi"].alias("pi")))

    return greedy_pairs(F.array_sort(F.flatten(F.transform(gold, candidates))))


def _by(df: DataFrame, keys: list[str], fields: tuple[str, ...], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def match(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., gi, pi): one-to-one pairs of the golden and predicted spans of a text."""
    texts = _by(gold, keys, ("gi", "inicio", "fim"), "gold").join(_by(pred, keys, ("pi", "inicio", "fim"), "pred"), keys)
    return match_texts(texts, keys)


def match_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.explode(span_pairs(F.col("gold"), F.col("pred"))).alias("_p")).select(*keys, "_p.gi", "_p.pi")


def text_events(gold: Column, pred: Column) -> Column:
    """The events of a text (see `events`)."""
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, ("nivel", "caso", "classe_g", "classe_p", "acerto", "confianca"))))

    def of_gold(g: Column, p: Column) -> Column:
        right = (g["classe"] == p["classe"]) & ((g["classe"] != "real") | F.coalesce(F.array_contains(g["ids"], p["id_canonico"]), F.lit(False)))
        return event(g["nivel"], F.when(p["pi"].isNotNull(), "par").otherwise("perdida"), g["classe"], p["classe"], F.coalesce(right.cast("int"), F.lit(0)), p["confianca"])

    def made(pairs: Column) -> Column:
        partner = lambda g: F.get(F.filter(pairs, lambda q: q["gi"] == g["gi"]), F.lit(0))["pi"]
        owned = F.transform(gold, lambda g: let(F.get(F.filter(pred, lambda p: p["pi"] == partner(g)), F.lit(0)), lambda p: of_gold(g, p)))
        held = F.filter(gold, lambda g: F.exists(pairs, lambda q: q["gi"] == g["gi"]))
        level = F.array_max(F.transform(gold, lambda g: g["nivel"]))
        loose = F.filter(pred, lambda p: ~F.exists(pairs, lambda q: q["pi"] == p["pi"]))
        part = lambda p: F.exists(held, lambda g: contained(p["inicio"], p["fim"], g["inicio"], g["fim"]))
        spurious = F.transform(loose, lambda p: event(level, F.when(part(p), "extra").otherwise("espuria"), none("string"), p["classe"], F.lit(0), none("double")))
        return F.concat(owned.cast(EVENT), spurious.cast(EVENT))

    return let(span_pairs(gold, pred), made)


def events(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., nivel, caso, classe_g, classe_p, acerto, confianca): one row a pair, a miss or a spurious prediction.

    gold: keys, nivel, gi, inicio, fim, classe, ids; pred: keys, pi, inicio, fim, classe,
    id_canonico, confianca. caso: par, perdida, espuria, extra (a spurious prediction
    inside a matched golden span, which doesn't count).
    """
    texts = _by(gold, keys, GOLD_FIELDS, "gold").join(_by(pred, keys, PRED_FIELDS, "pred"), keys, "left")
    return events_of_texts(texts, keys)


def events_of_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Events of texts (keys, gold, pred): arrays of the fields above; pred may be null."""
    empty = F.filter(F.array(F.get("pred", F.lit(0))), lambda _: F.lit(False))
    rows = texts.select(*keys, "gold", F.coalesce("pred", empty).alias("pred"))
    return rows.select(*keys, F.inline(text_events(F.col("gold"), F.col("pred"))))


def _counts(c: str) -> dict[str, Column]:
    """Conditional counts of a class: a wrong class counts against both classes, a wrong id against `real` only."""
    pair, hit = F.col("caso") == "par", F.col("acerto") == 1
    g, p = F.coalesce(F.col("classe_g") == c, F.lit(False)), F.coalesce(F.col("classe_p") == c, F.lit(False))
    same = F.coalesce(F.col("classe_g") == F.col("classe_p"), F.lit(False))
    return {
        "tp": F.count_if(g & pair & hit),
        "fp": F.count_if(p & ((F.col("caso") == "espuria") | (pair & ~hit))),
        "fn": F.count_if(g & ((F.col("caso") == "perdida") | (pair & ~same))),
        "suporte": F.count_if(g),
    }


def _tau() -> dict[str, Column]:
    bad = (F.col("caso") == "par") & (F.col("classe_g") == "inventada") & (F.col("classe_p") == "real")
    return {"graves": F.count_if(bad), "inventadas": F.count_if(F.col("classe_g") == "inventada")}


def _brier() -> dict[str, Column]:
    term = F.when((F.col("caso") == "par") & F.col("confianca").isNotNull(), F.pow(F.col("confianca") - F.col("acerto"), F.lit(2.0)))
    return {"n_conf": F.count(term), "brier": F.avg(term)}


def _tau_value() -> Column:
    return F.coalesce(F.try_divide(F.col("graves"), F.col("inventadas")), F.lit(0.0))


def _bonus_value() -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(BONUS), BONUS * (1 - F.col("brier")))), F.lit(0.0))


def _aggregate(ev: DataFrame, by: list[str], named: dict[str, Column]) -> DataFrame:
    return ev.groupBy(*by).agg(*(c.alias(n) for n, c in named.items()))


def confusion(ev: DataFrame, by: list[str]) -> DataFrame:
    """(by..., classe, tp, fp, fn, suporte) of the classes that occur; one aggregation."""
    wide = _aggregate(ev, by, {f"{n}_{c}": v for c in CLASSES for n, v in _counts(c).items()})
    rows = F.array(*(F.struct(F.lit(c).alias("classe"), *(F.col(f"{n}_{c}").alias(n) for n in ("tp", "fp", "fn", "suporte"))) for c in CLASSES))
    long = wide.select(*by, F.inline(rows))
    return long.where("tp + fp + fn + suporte > 0")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def tau(ev: DataFrame, by: list[str]) -> DataFrame:
    """(by..., graves, inventadas, tau): the share of invented golden citations that were taken for real."""
    return _aggregate(ev, by, _tau()).withColumn("tau", _tau_value())


def brier(ev: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_conf, brier, b): mean squared error of the confidences of pairs, and the bonus."""
    return _aggregate(ev, by, _brier()).withColumn("b", _bonus_value())


def score_levels(ev: DataFrame, by: list[str]) -> DataFrame:
    """(by..., nivel, macro_f1, f1_real, f1_inventada, f1_incompleta, tau, s, b, score): levels with golden citations.

    All counts of a level come from one aggregation over the events.
    """
    own = [*by, "nivel"]
    out = _aggregate(ev, own, {**{f"{n}_{c}": v for c in CLASSES for n, v in _counts(c).items()}, **_tau(), **_brier()})
    out = out.withColumns({f"f1_{c}": F.when(F.col(f"suporte_{c}") > 0, f1(F.col(f"tp_{c}"), F.col(f"fp_{c}"), F.col(f"fn_{c}"))) for c in CLASSES})
    held = F.filter(F.array(*(f"f1_{c}" for c in CLASSES)), lambda x: x.isNotNull())
    out = out.where(F.size(held) > 0).withColumn("macro_f1", F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))
    out = out.withColumn("tau", _tau_value()).withColumn("b", _bonus_value()).withColumn("s", F.col("macro_f1") * (1 - GAMMA * F.col("tau")))
    return out.select(*own, "macro_f1", *(f"f1_{c}" for c in CLASSES), "tau", "s", "b", (F.col("s") * (1 + F.col("b"))).alias("score"))


def score_final(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., score_final): the mean of the levels by their weights."""
    w = None
    for level, weight in LEVEL_WEIGHTS.items():
        w = F.when(F.col("nivel") == level, weight) if w is None else w.when(F.col("nivel") == level, weight)
    w = w.otherwise(1.0)
    total = [F.sum(w * F.col("score")), F.sum(w)]
    made = levels.groupBy(*by).agg(*(t.alias(n) for t, n in zip(total, ("_n", "_d"))))
    return made.select(*by, (F.col("_n") / F.col("_d")).alias("score_final"))


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def missing_rows(solution: DataFrame, submission: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the solution that the submission has no row for."""
    return solution.select(*keys).distinct().join(submission.select(*keys), keys, "left_anti")


def filled(solution: DataFrame, submission: DataFrame, keys: list[str], cell: str = "citacoes") -> DataFrame:
    """The submission with an empty cell ("-") for each missing key."""
    gap = missing_rows(solution, submission, keys).withColumn(cell, F.lit("-"))
    return submission.select(*keys, cell).unionByName(gap)


def required_columns(df: DataFrame, names: set[str], what: str) -> None:
    """Raise where columns are missing (a driver-side check of the schema)."""
    if gone := sorted(names - set(df.columns)):
        raise ValueError(f"columns missing in {what}: {gone}")
