"""Problem 7: mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded random order, repeated up to its
`max_repeticoes`. An item's virtual finish time is the tokens its source has sent up to
and including it, divided by the source's weight; the mix is the items of all queues by
virtual finish time, cut where the total size reaches the budget. At any virtual time
each source has sent its weight times that time, so the shares hold in every prefix.

Scale: the running sums (of a source, then of the whole mix) are prefix sums over
buckets. A bucket's total is pre-aggregated, the totals are summed in a table of as many
rows as there are buckets, and a window runs only inside a bucket, so that a source with
a third of all rows is spread over all tasks. Only sums reach the driver, and one row a
source where there are few.

Defined results: documents of null source, of a source that isn't in the mix or of no
tokens are left out (the report names them); a source without documents gets nothing and
the others keep their proportions; null or non-positive weights count as absent; equal
hashes are ordered by key; a budget beyond what all repetitions hold gives everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citaria.llm.tokens import TOKENIZERS, count_tokens
from citaria.session import shared_checkpoints

#: Sources up to which their weights are broadcast and the time of the cut is found on the driver; more are joined, and it is found by halving.
MAX_SOURCES = 10_000
#: Documents a bucket of a prefix sum should hold.
BUCKET_ROWS = 20_000


def prefix_sum(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of value within `by`, ordered by (bucket, *order), without one task for a whole `by`.

    A bucket must be a monotone function of the order.
    """
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_bucket_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, bucket, F.coalesce(F.sum("_bucket_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, [*by, bucket]).withColumn(out, F.col("_start") + F.sum(value).over(inside)).drop("_start")


def sized(documents: DataFrame, key: str, tokenizer: str, folder: str, seed: int) -> DataFrame:
    """(key, source, n_tokens, _h) of all documents, kept as a table so that texts are encoded once."""
    shared_checkpoints(documents.sparkSession)
    counted = count_tokens(documents.select(key, "source", "text"), [key, "source"], tokenizer=tokenizer, folder=folder)
    return counted.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).checkpoint()


def weights(mix: DataFrame, counted: DataFrame) -> DataFrame:
    """(source, _peso, _reps, _tokens, _docs, _end) of the sources of the mix that have documents; _end: virtual time at which a source runs dry."""
    have = counted.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_docs"))
    clean = mix.where("source is not null and peso > 0").groupBy("source").agg(F.sum("peso").cast("double").alias("_peso"), F.greatest(F.coalesce(F.max("max_repeticoes"), F.lit(1)), F.lit(1)).cast("int").alias("_reps"))
    return clean.join(have, "source").withColumn("_end", F.col("_reps") * F.col("_tokens") / F.col("_peso")).checkpoint()


def mix_documents(documents: DataFrame, mix: DataFrame, budget: int | None = None, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, seed: int = 42) -> DataFrame:
    """(key, source, repeticao INT from 1, n_tokens, fim_virtual DOUBLE, acumulado BIGINT), by virtual finish time.

    budget: total tokens; None takes the largest total at which no source with documents runs
    dry, but at least the tokens of all documents of the mix: sources that can't give their
    part of that fall short (`shares` tells), and don't shrink the mix.
    """
    return mixed(sized(documents, key, tokenizer, folder, seed), mix, budget, key)


def mixed(counted: DataFrame, mix: DataFrame, budget: int | None, key: str = "doc_id", max_sources: int = MAX_SOURCES) -> DataFrame:
    spark = counted.sparkSession
    facts = weights(mix, counted)
    sums = facts.agg(F.count(F.lit(1)).alias("n"), F.sum("_peso").alias("peso"), F.sum("_tokens").alias("tokens"), F.sum("_docs").alias("docs"), F.min("_end").alias("first"), F.max("_end").alias("last")).first()
    kind = counted.schema[key].dataType.simpleString()
    if not sums.n or budget == 0:
        return spark.createDataFrame([], f"`{key}` {kind}, source string, repeticao int, n_tokens bigint, fim_virtual double, acumulado bigint")
    if budget is None:
        budget = max(int(sums.first * sums.peso), sums.tokens)
    few = sums.n <= max_sources
    last = finish([(r._peso, r._end) for r in facts.select("_peso", "_end").collect()], budget) if few else halved(facts, sums.last, budget)
    buckets = max(8, min(1 << 20, sums.docs // BUCKET_ROWS * 4))
    facts = facts.select("source", "_peso", "_reps", "_tokens")
    facts = F.broadcast(facts) if few else facts
    queue = counted.where("n_tokens > 0").join(facts, "source").withColumn("_b", F.floor((F.shiftright("_h", 32) + F.lit(1 << 31)) * F.lit(buckets) / F.lit(float(1 << 32))).cast("int"))
    queue = prefix_sum(queue, ["source"], "_b", ["_h", key], "n_tokens", "_sent")
    # an item may pass `last` by its own size only; one pass more than the whole ones covers it
    passes = F.least(F.col("_reps"), F.ceil((F.lit(float(last)) * F.col("_peso")) / F.col("_tokens")).cast("int") + 1)
    items = queue.withColumn("repeticao", F.explode(F.sequence(F.lit(1), passes)))
    items = items.withColumn("fim_virtual", ((F.col("repeticao") - 1) * F.col("_tokens") + F.col("_sent")) / F.col("_peso"))
    items = items.where(F.col("fim_virtual") <= F.lit(float(last) * (1 + 1e-9) + 1))
    items = items.withColumn("_v", F.floor(F.col("fim_virtual") / F.lit(float(last) / buckets)).cast("int")).withColumn("_all", F.lit(0))
    items = prefix_sum(items, ["_all"], "_v", ["fim_virtual", "source", key, "repeticao"], "n_tokens", "acumulado")
    kept = items.where(F.col("acumulado") <= F.lit(budget))
    return kept.select(key, "source", F.col("repeticao").cast("int").alias("repeticao"), "n_tokens", "fim_virtual", "acumulado").orderBy("fim_virtual", "source", key)


def finish(live: list[tuple[float, float]], budget: int) -> float:
    """The virtual time by which sources (weight, time at which it runs dry) together have sent the budget."""
    at, sent, open_ = 0.0, 0.0, sorted(live, key=lambda s: s[1])
    rate = sum(w for w, _ in open_)
    for weight, until in open_:
        if sent + rate * (until - at) >= budget:
            return at + (budget - sent) / rate + max(1.0, budget * 1e-9)
        sent, at, rate = sent + rate * (until - at), until, rate - weight
    return at


def halved(facts: DataFrame, last: float, budget: int) -> float:
    """The same for a table of many sources, by halving the time: one sum a step."""
    sent = lambda t: facts.agg(F.sum(F.col("_peso") * F.least(F.col("_end"), F.lit(t)))).first()[0]
    low, high = 0.0, last
    if sent(high) < budget:
        return high
    while high - low > max(1.0, high * 1e-9):
        mid = (low + high) / 2
        low, high = (low, mid) if sent(mid) >= budget else (mid, high)
    return high + max(1.0, budget * 1e-9)


def shares(documents: DataFrame, mix: DataFrame, budget: int | None = None, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, seed: int = 42) -> DataFrame:
    """(source, peso, alvo, tokens_disponiveis, tokens, linhas, repeticoes, parte, desvio) of every source of the mix or of documents.

    alvo: target among the sources of the mix that have documents; parte: share reached;
    desvio: parte less alvo. peso is null for sources that aren't in the mix.
    """
    counted = sized(documents, key, tokenizer, folder, seed)
    done = mixed(counted, mix, budget, key).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("linhas"), F.max("repeticao").alias("repeticoes"))
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens_disponiveis"))
    want = mix.where("source is not null").groupBy("source").agg(F.sum("peso").alias("peso"))
    rows = want.join(have, "source", "full").join(done, "source", "left").na.fill(0, ["tokens", "linhas", "repeticoes", "tokens_disponiveis"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("parte", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
    live = F.when((F.col("peso") > 0) & (F.col("tokens_disponiveis") > 0), F.col("peso"))
    rows = rows.withColumn("alvo", F.try_divide(live, F.sum(live).over(Window.partitionBy(F.lit(0)))))
    return rows.select("source", "peso", F.round("alvo", 6).alias("alvo"), "tokens_disponiveis", "tokens", "linhas", "repeticoes", F.round("parte", 6).alias("parte"), F.round(F.col("parte") - F.col("alvo"), 6).alias("desvio"))
