"""Text scalars as Column expressions: they stay in the JVM. Plain ones are inside whole-stage
codegen; `let` and what uses it are higher-order functions, which Spark evaluates by interpretation.

Patterns carry (?U) and (?iuU) so that classes, white space and case follow Unicode.
Every function gives null for null.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scanner's letters and their digits.
OCR_LETTERS, OCR_DIGITS = "OolIiSgGB", "001115998"

# The patterns that decide how a citation is read.
DATE = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"
ARTICLE_CITED = r"art(?:igo)?s?\.?\s*(\d[\d.]*)"
ARTICLE_IN_CORPUS = r"Art\.?\s*(\d+)"
LAW_NUMBER = r"lei(?:\s+complementar)?(?:\s+n[º°.o]*)?\s*([\d.]+)\s*/\s*(\d{4})"
LAW_TYPE = r"\bart(?:igo)?s?\.?\s*(?:\d|correspondente)|\blei\b|\bc[oó]digos?\b|constitui[cç]|\b(?:CLT|CPC|CPP|CPM|CDC|CF)\b|\bdispositivo\b|\blegisla[cç]|\bnormas?\s+de\s+reg[eê]ncia"
SUMULA_CITED = r"[s5][uú]m(?:ula|\.)(?:\s+vinculante)?(?:\s+n[º°.o]*)?\s*(\d+)"
SUMULA_IN_CORPUS = r"s[uú]mula(?:\s+vinculante)?(?:\s+n[º°.o]*)?\s*(\d+)"
SUMULA_SEEN = r"[s5][uú]m(?:ula\b|\.)"
COURT = r"\b(STF|STJ|TST|TSE|STM)\b"
CNJ = r"\d{1,7}\s*-\s*\d{2}\s*\.\s*\d{4}\s*\.\s*\d\s*\.\s*\d{2}\s*\.\s*\d{4}"
HEADER_BLOCK = r"\d(?:[\d.\-/]\s*)+\d|\d{4,}"
CITED_BLOCK = r"\d(?:[\d.\-/\s]|[OolISgGB](?=[\d.\-/\s]|$))*(?:\d|[OolISgGB](?=[\d.\-/\s]|$))"
PROCESS_ANCHOR = r"PROCESSO\s+N[ºO°.]?\s*[:\-]?\s*.{0,90}"

# Laws by (number, year), and the ordered keyword rules of the two cascades.
LAW_ALIASES = {"13105/2015": "cpc", "8078/1990": "cdc", "10406/2002": "cc", "3689/1941": "cpp"}
CITED_CODES = (
    ("cpc", "codigo de processo civil", "cpc"),
    ("cpp", "codigo de processo penal", "cpp"),
    ("cdc", "codigo de defesa do consumidor", "cdc"),
    ("cc", "codigo civil", None),
    ("ce", "codigo eleitoral", None),
    ("cpm", "penal militar", "cpm"),
    ("clt", "consolidacao das leis do trabalho", "clt"),
    ("cf", "constitui", "cf"),
)
#: (code, alternatives; each alternative is a tuple of phrases that must all occur)
CORPUS_CODES = (
    ("cpm", [("administracao militar",)]),
    ("lc64", [("sao inelegiveis",)]),
    ("ce", [("tribunais eleitorais",), ("eleicoes federais",)]),
    ("cdc", [("fornecedor", "consumidor")]),
    ("cpp", [("prisao preventiva",)]),
    ("clt", [("tribunal superior do trabalho",), ("reclamante",), ("contrato de trabalho",)]),
    ("cf", [("estatuto da magistratura",), ("brasileiros e aos estrangeiros",), ("trabalhadores urbanos e rurais",), ("desta constituicao",)]),
    ("cpc", [("onus da prova", "ao autor")]),
    ("cc", [("ato ilicito",)]),
)
#: Code points of a part of a chunked text.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
DIPLOMA_PREFIX, HEADER_PREFIX, TST_PREFIX, NUMBER_PREFIX = 500, 240, 8000, 500


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; branches of a CASE would each evaluate it again."""
    return F.transform(F.array(value), body)[0]


def chunked(text: Column) -> Column:
    """The text in parts of CHUNK code points, for `slice_of`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def slice_of(chunks: Column, start: Column, length: Column) -> Column:
    """length code points of a chunked text from start (from 0). A substring of the whole text would be counted from its
    beginning each time, which makes many slices of a long text quadratic."""
    first = F.shiftright(start.cast("int"), CHUNK_BITS)
    within = start - first * CHUNK
    size = F.greatest(length, F.lit(0))
    part = F.array_join(F.slice(chunks, first + 1, F.shiftright((within + size).cast("int"), CHUNK_BITS) + 1), "")
    return F.substring(part, within + 1, size)


#: Characters beyond this aren't decomposed; above it are unassigned planes.
LAST_LETTER = 0x2FA20
#: Characters that stand for several and are common in these texts; the others are looked up one by one.
COMMON_SEVERAL = "…™½¼¾№ﬁﬂﬀ℃"


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes; those without a counterpart are dropped, characters that become several) under
    compatibility decomposition without combining marks. Hangul syllables stay composed."""
    one, none, several = {}, [], {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, LAST_LETTER)):
        c = chr(code)
        made = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if made == c:
            continue
        if len(made) == 1:
            one[c] = made
        elif made:
            several[c] = made
        else:
            none.append(c)
    return "".join([*one, *none]), "".join(one.values()), several


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks: nothing to do for ASCII, one pass for letters that stay one,
    another where a text holds others. (Sets of characters are looked up by translate, whose table is hashed.)"""
    letters, plain, several = decompositions()
    holds = lambda t, chars: F.length(F.translate(t, chars, "")) < F.length(t)

    def expanded(t: Column) -> Column:
        for x in COMMON_SEVERAL:
            t = F.replace(t, F.lit(x), F.lit(several[x]))
        rest = {k: v for k, v in several.items() if k not in COMMON_SEVERAL}
        table = F.from_json(F.lit(json.dumps(rest)), "map<string,string>")
        each = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
        return F.when(holds(t, "".join(rest)), each).otherwise(t)

    whole = F.translate(F.when(holds(c, "".join(several)), let(c, expanded)).otherwise(c), letters, plain)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(whole)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def strip_dates(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + DATE, " ")


def strip_zeros(c: Column) -> Column:
    """Without leading zeros; "0" where nothing else is left."""
    bare = F.regexp_replace(c, "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def norm_id(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]+$"), strip_zeros(t)).otherwise(t)


def repair_digits(c: Column) -> Column:
    return F.translate(c, OCR_LETTERS, OCR_DIGITS)


def base_form(c: Column) -> Column:
    """Without accents, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"(?U)\s+", " "))


def long_words(c: Column) -> Column:
    """Distinct words of four letters or more of a text in base form."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z]{4,})"), F.lit(1)))


def useful_number(digits: Column) -> Column:
    """Four digits or more, and not a year of the 20th or 21st century."""
    return (F.length(digits) >= 4) & ~digits.rlike(r"^(19|20)\d{2}$")


def citation_type(c: Column) -> Column:
    return F.when(c.rlike("(?iuU)" + LAW_TYPE), "lei").otherwise("jurisprudencia")


def sumula_seen(c: Column) -> Column:
    return c.rlike("(?iuU)" + SUMULA_SEEN)


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def cited_article(c: Column) -> Column:
    """Article number of a citation, points removed: 1.021 is 1021."""
    d = digits_only(_extract(c, "(?iuU)" + ARTICLE_CITED))
    return F.when(d != "", strip_zeros(d))


def corpus_article(c: Column) -> Column:
    """Article number of a corpus text; stops at a point: Art. 1.021 is 1."""
    return strip_zeros(_extract(c, "(?iuU)" + ARTICLE_IN_CORPUS))


def cited_code(c: Column) -> Column:
    """Code that a citation names: law number first, then the keyword rules in order; null for none."""
    def named(x: Column) -> Column:
        b, number, year = x["b"], x["number"], x["year"]
        key = F.concat_ws("/", number, year)
        law = F.when(b.contains("complementar") & (key == "64/1990"), "lc64")
        for k, code in LAW_ALIASES.items():
            law = law.when(key == k, code)
        out = F.when(year.isNotNull(), law.otherwise(F.concat(F.lit("lei-"), number, F.lit("-"), year)))
        for code, phrase, abbreviation in CITED_CODES:
            hit = b.contains(phrase)
            if abbreviation:
                hit = hit | b.rlike(rf"(?U)\b{abbreviation}\b")
            out = out.when(hit, code)
        return out

    def parts(b: Column) -> Column:
        number = strip_zeros(digits_only(_extract(b, "(?iuU)" + LAW_NUMBER, 1)))
        return F.struct(b.alias("b"), number.alias("number"), _extract(b, "(?iuU)" + LAW_NUMBER, 2).alias("year"))

    return let(let(base_form(c), parts), named)


def corpus_code(c: Column) -> Column:
    """Code that a corpus text belongs to, by the keyword rules on its first characters."""
    def rules(b: Column) -> Column:
        out = None
        for code, alternatives in CORPUS_CODES:
            hit = F.lit(False)
            for phrases in alternatives:
                both = F.lit(True)
                for p in phrases:
                    both = both & b.contains(p)
                hit = hit | both
            out = F.when(hit, code) if out is None else out.when(hit, code)
        return out

    return let(base_form(F.substring(c, 1, DIPLOMA_PREFIX)), rules)


def cited_sumula(c: Column) -> Column:
    return strip_zeros(_extract(strip_accents(c), "(?iuU)" + SUMULA_CITED))


def corpus_sumula(c: Column) -> Column:
    return strip_zeros(_extract(c, "(?iuU)" + SUMULA_IN_CORPUS))


def cited_court(c: Column) -> Column:
    return F.upper(_extract(c, "(?iuU)" + COURT))


def is_binding(c: Column) -> Column:
    return c.rlike("(?iu)vinculante")


def numbers_in(c: Column, pattern: str) -> Column:
    """Distinct useful numbers of the matches of a pattern, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"(?U)({pattern})"), F.lit(1)), lambda x: digits_only(repair_digits(x)))
    return F.array_distinct(F.filter(found, useful_number))


def cited_numbers(c: Column) -> Column:
    """Case numbers of a citation, scanner letters read as digits, dates left out."""
    return numbers_in(strip_dates(c), CITED_BLOCK)


def header_numbers(court: Column, c: Column) -> Column:
    """Case numbers in the header of a ruling: labour court by its fixed form, others the first one (STJ: two)."""
    first = F.slice(F.regexp_extract_all(F.substring(c, 1, TST_PREFIX), F.lit(f"(?U)({CNJ})"), F.lit(1)), 1, 1)
    anchor = F.regexp_extract(c, f"(?iuU)({PROCESS_ANCHOR})", 1)
    anchored = F.slice(F.regexp_extract_all(anchor, F.lit(f"(?U)({CNJ})"), F.lit(1)), 1, 1)
    labour = F.array_distinct(F.transform(F.concat(first, anchored), digits_only))
    blocks = F.transform(F.regexp_extract_all(strip_dates(F.substring(c, 1, NUMBER_PREFIX)), F.lit(f"(?U)({HEADER_BLOCK})"), F.lit(1)), digits_only)
    others = F.array_distinct(F.filter(blocks, useful_number))
    return F.when(court == "TST", labour).when(court == "STJ", F.slice(others, 1, 2)).otherwise(F.slice(others, 1, 1))


def context(text: Column, start: Column, end: Column, half: int = 250) -> Column:
    """The text around a span."""
    a = F.greatest(F.lit(0), start - half)
    return F.substring(text, a + 1, end + half - a)


def list_of_ids(c: Column) -> Column:
    """Ids of a cell, parted by white space or colons, a lone hyphen dropped."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)[\s:]+"), lambda x: (x != "") & (x != "-"))


def model_slug(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def checksum(c: Column, modulus: int = 10_000) -> Column:
    """Adler-32 of the text's bytes modulo a number: what a row's seed is made of. Meant for keys; a fold over bytes."""
    prime = F.lit(65_521)
    codes = F.transform(F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1)), lambda b: F.conv(b, 16, 10).cast("bigint"))
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))

    def step(s: Column, x: Column) -> Column:
        return let((s["a"] + x) % prime, lambda a: F.struct(a.alias("a"), ((s["b"] + a) % prime).alias("b")))

    return F.when(c.isNotNull(), F.aggregate(codes, start, step, lambda s: (s["b"] * 65_536 + s["a"]) % modulus))
