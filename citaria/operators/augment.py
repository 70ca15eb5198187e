"""Variants of texts that keep their citations, and the samples around them.

All draws are hashes of a row's key and a seed, so that results are the same at any
partitioning and after a lost executor. Free text is changed, fixed text (the spans) is
not; only folds over the parts of a text, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citaria.functions.spans import segments
from citaria.functions.text import let

# Phrases and their replacements, sentences, names, places.
SYNONYMS = (
    ("Cumpre observar que", "Convém registrar que"),
    ("Cumpre destacar", "Importa sublinhar"),
    ("Cumpre lembrar", "Cabe recordar"),
    ("Vale invocar", "Cabe trazer à colação"),
    ("Antes de avançar, convém delimitar", "De início, cabe precisar"),
    ("A questão de fundo comporta solução", "O mérito admite deslinde"),
    ("O ponto nodal da discussão reside", "O cerne da controvérsia está"),
    ("A parte contrária limita-se a repisar", "A parte adversa se restringe a reiterar"),
    ("Nesse exato sentido caminha", "Na mesma direção segue"),
    ("O raciocínio desenvolvido no acórdão recorrido parte de premissa equivocada", "O acórdão recorrido assenta premissa que não se sustenta"),
    ("É o que se tinha a expor", "Era o que cumpria expor"),
    ("Decido.", "Passo a decidir."),
    ("Vieram os autos conclusos.", "Os autos retornaram conclusos."),
)
SENTENCES = (
    "Os autos foram distribuídos livremente a este gabinete.",
    "Não há preliminar de nulidade a examinar de ofício.",
    "O preparo foi comprovado nos autos.",
    "A intimação da parte contrária observou o prazo legal.",
    "O exame se limita ao que foi devolvido no recurso.",
)
NAMES = ("HELENA DUARTE PIMENTEL", "OFICINA LITORAL LTDA.", "COOPERATIVA VALE VERDE", "MARINA COSTA ALBUQUERQUE", "METALÚRGICA SERRA DOURADA S.A.", "PAULO HENRIQUE VASCONCELOS")
CITIES, CITIES_OUT = ("Recife", "Curitiba", "Belém", "Florianópolis", "Campo Grande"), ("Fortaleza", "São Paulo", "Brasília", "Rio de Janeiro", "Belo Horizonte", "Porto Alegre")
MONTHS = ("janeiro", "março", "maio", "agosto", "outubro")
# What a scanner mistakes, and the share of letters that it mistakes.
OCR_SWAPS = {"a": "ã", "e": "c", "o": "e", "i": "l", "u": "n", "m": "rn"}
OCR_SHARE = 0.04
# Fixed value: the paragraph that closes a longer text.
CLOSING = "\n\nNada mais havendo a considerar no âmbito deste exame, encaminhem-se os autos ao arquivo próprio após as anotações de praxe, com ciência às partes pelo meio ordinário. ({}.)\n"
# Fixed value: what every request asks for.
REQUEST = (
    ". Tamanho entre 2200 e 3400 caracteres. Inclua de 6 a 10 citações: leis com artigo e diploma, julgados com número, menções sem número e ao menos um identificador inventado. "
    "Invente relatores, datas e números. Prosa contínua, sem lista e sem título de seção. Variação "
)
# What synthetic pieces are drawn from.
GENRES = ("memorial", "voto", "acórdão", "decisão monocrática", "parecer", "embargos de declaração")
COURTS = ("STF", "STJ", "TST", "TSE", "STM", "TJSP", "TRF4", "TRT3")
TOPICS = (
    "prescrição intercorrente", "competência da justiça do trabalho", "tutela de urgência em contrato administrativo", "responsabilidade civil por acidente de trânsito", "improbidade e dolo específico",
    "execução fiscal e prescrição", "adicional de insalubridade", "guarda compartilhada", "recuperação judicial e crédito trabalhista", "mandado de segurança contra ato de mesa",
    "aposentadoria especial", "usucapião extrajudicial", "despejo por falta de pagamento", "habeas corpus e prisão preventiva", "licitação e sobrepreço",
)
# What numbers, dates, parties and sentences are found by.
PROCESS, SHEETS, AMOUNT, LONG_DATE = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", r"(?i)fls\.\s*\d+/\d+", r"R\$\s*[\d.]+,\d{2}", r"(?iu)\d{1,2} de [a-zç]+ de \d{4}"
PARTY = r"(?m)^[\wÀ-ú/ .()-]{0,40}:\s*([A-ZÁÉÍÓÚÂÊÔÃÕÇ][A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9 ./-]{8,})$"
SENTENCE_END = r"(?<=[.!?])\s+"
OPERATIONS = ("sinonimos", "ocr", "insere", "remove_frase", "troca_nomes", "troca_protocolo", "reordena", "troca_data", "expande", "combina")


def draw(n: int | Column, *what: Column | str | int) -> Column:
    """A number from 0 to n-1 that depends on what is given only (the head of an MD5)."""
    parts = [w.cast("string") if isinstance(w, Column) else F.lit(str(w)) for w in what]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint"), n if isinstance(n, Column) else F.lit(n))


def pick(values: tuple[str, ...], *what) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(len(values), *what) + 1).cast("int"))


def free(parts: Column, change) -> Column:
    """change(text, index) on the free parts."""
    return F.transform(parts, lambda p, i: F.struct(p["tipo"].alias("tipo"), F.when(p["tipo"] == "livre", change(p["trecho"], i)).otherwise(p["trecho"]).alias("trecho")))


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["trecho"]), "")


def replace_each(text: Column, pattern: str, make) -> Column:
    """Replace the k-th match of a pattern by make(k)."""
    between = F.split(text, pattern, -1)
    return F.array_join(F.transform(between, lambda p, k: F.when(k < F.size(between) - 1, F.concat(p, make(k))).otherwise(p)), "")


def synonyms(parts: Column, seed: Column) -> Column:
    def change(t: Column, _: Column) -> Column:
        for a, b in SYNONYMS:
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    return free(parts, change)


def squared(c: Column) -> Column:
    return let(c, lambda x: x * x)


def ocr_noise(parts: Column, seed: Column) -> Column:
    swaps = F.create_map(*(F.lit(x) for a, b in OCR_SWAPS.items() for x in (a, b, a.upper(), b.upper())))
    limit, prime = int(OCR_SHARE * 10_000), F.lit(2**31 - 1)

    def noisy(own: Column) -> Column:
        def hit(i: Column, k: Column) -> Column:  # a square modulo a prime: a draw for each character without a hash of text
            return F.pmod(F.pmod(squared(F.pmod(own + i * 7919 + k * 104_729, prime)) + 12_345, prime), F.lit(10_000)) < limit

        def change(t: Column, i: Column) -> Column:
            return F.array_join(F.transform(F.split(t, ""), lambda c, k: F.when(hit(i, k), F.coalesce(F.try_element_at(swaps, c), c)).otherwise(c)), "")

        return free(parts, change)

    return let(draw(2**32, seed), noisy)


def chosen(flags: Column, seed: Column, what: str) -> Column:
    """Index of one true element of a boolean array; null for none."""
    at = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.try_element_at(at, (draw(F.greatest(F.size(at), F.lit(1)), seed, what) + 1).cast("int")))


def insert_sentence(parts: Column, seed: Column) -> Column:
    at = chosen(F.transform(parts, lambda p: (p["tipo"] == "livre") & (F.length(p["trecho"]) > 80)), seed, "onde")
    return let(at, lambda at: free(parts, lambda t, i: F.when(i == at, F.concat(F.regexp_replace(t, r"(?U)\s+$", ""), F.lit(" "), pick(SENTENCES, seed, "frase"), F.lit("\n"))).otherwise(t)))


def drop_sentence(parts: Column, seed: Column) -> Column:
    def change(t: Column, i: Column) -> Column:
        def without(each: Column) -> Column:
            at = chosen(F.transform(each, lambda s: (F.length(s) > 40) & (F.length(s) < 180)), F.concat_ws("|", seed, i.cast("string")), "frase")
            return let(at, lambda at: F.when(at.isNotNull(), F.array_join(F.filter(each, lambda _, k: k != at), " ")).otherwise(t))

        return let(F.split(t, SENTENCE_END, -1), without)

    return free(parts, change)


def swap_names(parts: Column, seed: Column) -> Column:
    """Lines end at \\n alone, so that a name before \\r isn't one."""
    found = F.filter(F.transform(F.regexp_extract_all(joined(parts), F.lit("(?d)" + PARTY), F.lit(1)), F.trim), lambda n: F.length(n) > 8)
    names, start = F.array(*map(F.lit, NAMES)), draw(len(NAMES), seed, "nomes")
    pairs = F.transform(F.slice(found, 1, len(NAMES)), lambda n, k: F.struct(n.alias("n"), F.element_at(names, (F.pmod(start + k, F.lit(len(NAMES))) + 1).cast("int")).alias("new")))
    return let(pairs, lambda pairs: free(parts, lambda t, _: F.aggregate(pairs, t, lambda s, x: F.replace(s, x["n"], x["new"]))))


def between(low: int, high: int, *what) -> Column:
    return (draw(high - low + 1, *what) + low).cast("string")


def swap_numbers(parts: Column, seed: Column) -> Column:
    def change(t: Column, i: Column) -> Column:
        process = F.concat(between(1_000_000, 9_999_999, seed, i, "a"), F.lit("-"), between(10, 99, seed, i, "b"), F.lit("."), between(2018, 2024, seed, i, "c"), F.lit("."), between(1, 8, seed, i, "d"), F.lit("."), F.lpad(between(1, 27, seed, i, "e"), 2, "0"), F.lit("."), F.lpad(between(1, 9999, seed, i, "f"), 4, "0"))
        t = replace_each(t, PROCESS, lambda _: process)
        t = replace_each(t, SHEETS, lambda k: F.concat(F.lit("fls. "), between(100, 900, seed, i, k, "g"), F.lit("/"), between(100, 980, seed, i, k, "h")))
        return replace_each(t, AMOUNT, lambda k: F.concat(F.lit("R$ "), between(1, 80, seed, i, k, "v"), F.lit(".000,00")))

    return free(parts, change)


def swap_dates(parts: Column, seed: Column) -> Column:
    city = pick(CITIES, seed, "cidade")

    def change(t: Column, i: Column) -> Column:
        for name in CITIES_OUT:
            t = F.replace(t, F.lit(name), city)
        return replace_each(t, LONG_DATE, lambda k: F.concat(between(1, 28, seed, i, k, "d"), F.lit(" de "), pick(MONTHS, seed, i, k, "m"), F.lit(" de "), between(2020, 2025, seed, i, k, "a")))

    return free(parts, change)


def add_closing(parts: Column, seed: Column) -> Column:
    tail = F.concat(F.lit(CLOSING.split("{}")[0]), pick(CITIES, seed, "fim"), F.lit(CLOSING.split("{}")[1]))
    return F.transform(parts, lambda p, i: F.struct(p["tipo"].alias("tipo"), F.when(i == F.size(parts) - 1, F.concat(p["trecho"], tail)).otherwise(p["trecho"]).alias("trecho")))


def combine(parts: Column, seed: Column) -> Column:
    return let(insert_sentence(synonyms(parts, seed), seed), lambda p: swap_numbers(p, seed))


def reorder(text: Column, spans: Column, seed: Column) -> Column:
    """Permute the paragraphs that no span touches; the others stay in place."""
    blocks = F.split(text, "\n\n", -1)
    kind = "array<struct<a:int,b:int,t:string>>"
    placed = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("l")),
        lambda s, t: F.struct((s["at"] + F.length(t) + 2).alias("at"), F.concat(s["l"], F.array(F.struct(s["at"].alias("a"), (s["at"] + F.length(t)).alias("b"), t.alias("t")))).alias("l")),
        lambda s: s["l"],
    )
    flagged = F.transform(placed, lambda x, k: F.struct(k.alias("k"), x["t"].alias("t"), (~F.exists(spans, lambda s: (s["inicio"] < x["b"]) & (s["fim"] > x["a"]))).alias("free")))

    def permuted(flagged: Column) -> Column:
        loose = F.filter(flagged, lambda x: x["free"])
        order = F.array_sort(F.transform(loose, lambda x: F.struct(F.md5(F.concat_ws("|", seed, x["k"].cast("string"))).alias("h"), x["k"].alias("k"), x["t"].alias("t"))))
        both = F.struct(F.transform(loose, lambda x: x["k"]).alias("places"), F.transform(order, lambda x: x["t"]).alias("texts"))
        moved = lambda b: F.transform(flagged, lambda x: F.when(x["free"], F.get(b["texts"], F.array_position(b["places"], x["k"]).cast("int") - 1)).otherwise(x["t"]))
        return let(both, lambda b: F.when(F.size(b["places"]) < 2, text).otherwise(F.array_join(moved(b), "\n\n")))

    return let(flagged, permuted)


CHANGES = {"sinonimos": synonyms, "ocr": ocr_noise, "insere": insert_sentence, "remove_frase": drop_sentence, "troca_nomes": swap_names, "troca_protocolo": swap_numbers, "troca_data": swap_dates, "expande": add_closing, "combina": combine}


def variant(text: Column, spans: Column, operation: str, seed: Column) -> Column:
    """A text changed by one operation; spans: sorted and disjoint."""
    if operation == "reordena":
        return reorder(text, spans, seed)
    return let(segments(text, spans), lambda parts: joined(CHANGES[operation](parts, seed)))


def variants(docs: DataFrame, keys: list[str], seed: int = 42, operations: tuple[str, ...] = OPERATIONS, strict: bool = False) -> DataFrame:
    """(keys..., operacao, variante, perdidas INT) of docs (keys, texto, spans): one row a text and operation.

    perdidas: spans whose text is no longer in the variant (0 unless text is broken); strict
    stops at the first. One pass over the texts, each is exploded into its variants without a shuffle.
    """
    own = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    seeded = docs.select(*keys, "texto", "spans", own.alias("_seed"), F.explode(F.array(*map(F.lit, operations))).alias("operacao"))
    made = None
    for op in operations:
        v = variant(F.col("texto"), F.col("spans"), op, F.concat_ws("|", F.col("_seed"), F.lit(op)))
        made = F.when(F.col("operacao") == op, v) if made is None else made.when(F.col("operacao") == op, v)
    rows = seeded.withColumn("_v", F.struct("operacao", made.alias("variante")))
    kept = F.transform("spans", lambda s: F.contains(F.col("_v.variante"), F.substring(F.col("texto"), s["inicio"] + 1, s["fim"] - s["inicio"])))
    lost = F.size(F.filter(kept, lambda x: ~x))
    if strict:
        lost = let(lost, lambda n: F.when(n > 0, F.raise_error(F.concat(F.lit("citations lost by "), F.col("_v.operacao"))).cast("int")).otherwise(n))
    return rows.select(*keys, "_v.operacao", "_v.variante", lost.alias("perdidas"))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the smallest hashes of their key (a sampling operator; ties by key)."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def requests(n: int | None, spark, seed: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """(indice, pedido): prompts for synthetic pieces, drawn by index and round."""
    base = spark.range(1, n + 1).withColumnRenamed("id", "indice") if ids is None else ids
    i = F.col("indice")
    text = F.concat(
        F.lit("Escreva um "), pick(GENRES, i, seed, "g"), F.lit(" do "), pick(COURTS, i, seed, "t"), F.lit(" sobre "), pick(TOPICS, i, seed, "m"),
        F.lit(REQUEST), i.cast("string"), F.lit("."),
    )
    return base.select("indice", text.alias("pedido"))


#: Sampling temperature before the first round, and what each round adds.
TEMPERATURE, TEMPERATURE_STEP = 0.7, 0.1


def temperature(round_: int) -> float:
    """Sampling temperature of a round (from 1): it rises, so that rejected rows are tried otherwise."""
    return round(TEMPERATURE + TEMPERATURE_STEP * round_, 6)


def until_accepted(ids: DataFrame, attempt, rounds: int = 4) -> DataFrame:
    """Retry the rows that attempt(ids, round) doesn't return, up to a number of rounds; an error if some are left.

    attempt gives (indice, ...) of the accepted ones; `temperature` is what a model is to sample with in a round. The state between rounds is checkpointed.
    """
    from citaria.session import shared_checkpoints

    shared_checkpoints(ids.sparkSession)
    left, done = ids.select("indice"), None
    for k in range(1, rounds + 1):
        got = attempt(left, k).checkpoint()
        done = got if done is None else done.unionByName(got)
        left = left.join(got.select("indice"), "indice", "left_anti").checkpoint()
        if left.isEmpty():
            return done
    raise RuntimeError(f"{left.count()} rows were never accepted")
