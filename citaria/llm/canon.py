"""Problem 1: map freely written mentions of legal sources to a reference list.

Method: a multi-pattern automaton (Aho-Corasick) over aliases turns a normalised text
into symbols (kinds, courts, codes, numbers); a second automaton over the canonical
names of the entries, in symbols, finds the mentions embedded in it; the longest match
wins. What stays unmatched goes to token-set similarity: its words are corrected to the
nearest word of the aliases and looked up again; then the words that name a court or a
code are compared, as a set, with those of the entries of the same number and kind.

The names come from the list: courts and codes, with their long forms, abbreviations and
acts, are read from `tribunal`, `rotulo` and `descricao`; the spellings below are further
aliases of some of them. An entry whose label has no number is named by its whole label,
one of a kind that isn't known by the words before and after its number.

Scale: no shuffle. The names of courts and codes and up to MAX_ENTRIES entries are
broadcast; a longer list is taken in blocks of that many, one after the other, each with
its own automaton, against all rows; a mention carries its length, place and score, so
that the result doesn't depend on the blocks. Repeated texts are matched once a task.

Defined results: a null or blank text is mapped only through its hand-filled id; text that
names two entries gets the longest mention, of equals the first; two entries of the same
canonical name: the smaller id; entries that are equally similar: "-" with via "empate";
rows that name nothing get "-"; repeated rows are mapped each; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.session import shared_checkpoints

#: Entries in one automaton; a longer list is taken in blocks.
MAX_ENTRIES = 200_000
#: Distinct ways in which the entries' labels name a court or code; more are an error, as they go to every worker.
MAX_NAMES = 200_000
#: Token-set similarity that the second stage asks for.
MIN_SIMILARITY = 0.75
#: Texts a task remembers: bounds its memory, doesn't change results.
REMEMBERED = 200_000

# Symbols and the ways they are written, without accents and in lower case.
KINDS = {
    "SUM": ("sumula", "sumulas", "sum", "5umula", "5um", "enunciado", "enunciado sumular", "enunciado da sumula", "enunciado de sumula", "verbete", "verbete sumular", "verbete da sumula", "sumular", "smula", "en"),
    "VIN": ("vinculante", "vinculantes", "vinc"),
    "SUM VIN": ("sv", "sumula vinculante", "s v", "sum vinc"),
    "ART": ("art", "arts", "artigo", "artigos"),
}
COURTS = {
    "STF": ("stf", "s t f", "supremo tribunal federal", "supremo", "pretorio excelso", "excelso pretorio"),
    "STJ": ("stj", "s t j", "superior tribunal de justica"),
    "TST": ("tst", "t s t", "tribunal superior do trabalho"),
    "TSE": ("tse", "t s e", "tribunal superior eleitoral"),
    "STM": ("stm", "s t m", "superior tribunal militar"),
}
CODES = {
    "CC": ("codigo civil", "cc", "c civil", "cod civil", "ccb", "cc 2002", "cc 02", "lei 10406 2002", "lei 10406 02", "lei 10406"),
    "CPC": ("codigo de processo civil", "cpc", "cpc 2015", "cpc 15", "ncpc", "c p civil", "lei 13105 2015", "lei 13105 15", "lei 13105"),
    "CPP": ("codigo de processo penal", "cpp", "c p penal", "lei 3689 1941", "lei 3689 41", "lei 3689"),
    "CDC": ("codigo de defesa do consumidor", "cdc", "codigo do consumidor", "lei 8078 1990", "lei 8078 90", "lei 8078"),
    "CF": ("constituicao federal", "cf", "cf 88", "cf 1988", "crfb", "crfb 88", "crfb 1988", "constituicao da republica", "constituicao", "carta magna", "constituicao federal de 1988", "constituicao da republica federativa do brasil"),
    "CE": ("codigo eleitoral", "c eleitoral", "cod eleitoral", "lei 4737 1965", "lei 4737 65", "lei 4737"),
    "CLT": ("consolidacao das leis do trabalho", "consolidacao das leis trabalhistas", "clt", "lei 5452 1943", "lei 5452 43", "lei 5452"),
    "CPM": ("codigo penal militar", "cpm", "c p m", "lei 1001 1969", "lei 1001 69", "lei 1001"),
    "LC64": ("lei das inelegibilidades", "lei de inelegibilidades", "lei da inelegibilidade", "lc 64 90", "lc 64 1990", "lc 64", "lei complementar 64 90", "lei complementar 64 1990", "lei complementar 64"),
}
#: Words that are written short in the names of courts and codes.
ABBREVIATED = {"cod": "codigo", "const": "constituicao", "proc": "processo", "trib": "tribunal", "sup": "superior", "fed": "federal", "just": "justica"}
#: The letters that scanners put for digits.
SCANNED = {ord(a): b for a, b in zip("OoQDlIi|SsGgBZz", "000011115599822")}

#: Words that don't tell entries apart; dropped between symbols.
FILLER = frozenset("a o as os e da do das dos de d n no nº num numero nr nro colendo egregio excelso c eg col prevista previsto na no nos em pelo pela ed edcl agint agrg re".split())

#: A digit, then digits and scanner letters, in groups parted by a point, a hyphen or a space (the latter two only before a group with a digit).
NUMBER = r"\d[\dOolISgGBZ]*(?:(?:\s?\.\s?|(?:\s?[\-–]\s?|\s)(?=[OolISgGBZ]*\d))[\dOolISgGBZ]+(?![^\W\d_]))*"
SPACES = re.compile(r"\s+")
DATES = re.compile(r"\b\d{1,2}\s?/\s?\d{1,2}\s?/\s?\d{2,4}\b|\b\d{1,2}[º°]? de [^\W\d]+ de \d{4}\b|\bde\s+(?:19|20)\d{2}\b(?![.\d])", re.I)
TRAILERS = re.compile(r"\b(?:rel(?:ator|atora)?\b\.?|min\.|dje\b|dj\b|j\.(?=\s*[\d;])|julg(?:ad[oa]|\.)\s+em|publ\w*)[^;]*$", re.I)
QUALIFIERS = re.compile(
    r"§+\s*(?:unico|\d+[ºo°.]?(?:\s*(?:,|e|a)\s*\d+[ºo°]?)*)|\bpar(?:agrafo|\.)?\s+(?:unico|\d+)|\binc(?:iso)?s?\.?\s+[ivxlcdm\d]+\b|\bal(?:inea)?s?\.?\s+['\"“”‘’]?[a-z]\b['\"“”‘’]?\)?|\bcaput\b|\bitens?\s+\d+|\bitem\s+\d+",
    re.I,
)
ROMAN = re.compile(r"(?<![^\s,;e])\b(?=[LC]*[IVX])[IVXLC]+\b(?:\s*(?:,|e|a|-)\s*(?=[LC]*[IVX])[IVXLC]+\b)*(?=[\s,;]|$)")


class Unmarked(dict):
    """For str.translate: drops combining marks."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.combining(chr(code)) else code
        return self[code]


UNMARKED = Unmarked()
#: Ordinal signs become spaces, characters without width go.
SIGNS = {**dict.fromkeys(map(ord, "ºª°˚"), " "), **dict.fromkeys((0xAD, 0x200B, *range(0x200C, 0x200E), 0x2060, 0xFEFF))}


def plain(text: str) -> str:
    """Without accents and marks that carry nothing; ordinal signs and odd spaces become spaces."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKD", text.translate(SIGNS)).translate(UNMARKED)


def longest(auto: ahocorasick.Automaton, text: str) -> list[tuple[int, int, object]]:
    """Longest non-overlapping matches of patterns framed by single spaces, as (start, end, value), of equals the first."""
    found = [(last - value[1], last, value[0]) for last, value in auto.iter(text)]
    found.sort(key=lambda m: (m[0] - m[1], m[0]))
    taken, held = [], bytearray(len(text))
    for m in found:  # a taken match is no shorter, so that one which meets it covers an end of this one
        if not (held[m[0]] or held[m[1] - 1]):
            held[m[0] : m[1]] = b"\1" * (m[1] - m[0])
            taken.append(m)
    taken.sort()
    return taken


def digits(chunk: str) -> str:
    """The number that a chunk of digits, separators and scanner letters stands for, without leading zeros."""
    return re.sub(r"\D", "", chunk.translate(SCANNED)).lstrip("0") or "0"


#: Without one of these in a text the patterns can't match.
TRAILER_WORDS, QUALIFIER_WORDS = ("rel", "min.", "dj", "j.", "julg", "publ"), ("§", "par", "inc", "al", "caput", "iten", "item")
ACT = re.compile(r"\b(?:decreto[\s\-]*)?(?:dec\.?[\s\-]*)?(lei|lc)(\s+c[a-z]{8,13})?\s*(?:federal\s*)?(?:n[.ro]*\s*)?([\d.]+)\s*(?:/|,?\s+de\s+)\s*(\d{2,4})", re.I)
CODE_YEAR = re.compile(r"\b(cpc|cf|crfb|cc)\s*/\s*(\d{2,4})", re.I)


def symbols(text: str) -> list[str]:
    """The text as a list of symbols, numbers (# and digits) and unknown words."""
    s = plain(text)
    low = s.lower()
    if "/" in s or " de " in low or "de " in low:
        s = DATES.sub(" ; ", s)
    if any(w in low for w in TRAILER_WORDS):
        s = TRAILERS.sub(" ", s)
    if "lei" in low or "lc" in low:
        s = ACT.sub(lambda m: f" ~{m[1]}{' complementar' if m[2] else ''} {re.sub(r'[^0-9]', '', m[3]).lstrip('0')} {m[4]}~ ", s)
    if "/" in s:
        s = CODE_YEAR.sub(r" ~\1 \2~ ", s)
    acts: list[str] = []

    def keep(m: re.Match) -> str:
        acts.append(m[1])
        return f" \x01{len(acts) - 1}\x02 "

    if "~" in s:
        s = re.sub("~([^~]*)~", keep, s)
    if any(w in low for w in QUALIFIER_WORDS):
        s = QUALIFIERS.sub(" , ", s)
    s = ROMAN.sub(" , ", s)
    numbers: list[str] = []

    def number(m: re.Match) -> str:
        ordinal = re.fullmatch(r"\d[oO]", m[0]) and re.search(r"\bart\w*\W*$", s[: m.start()], re.I)
        numbers.append(m[0][0] if ordinal else digits(m[0]))
        return f" \x03{len(numbers) - 1}\x04 "

    if "5u" in s:
        s = re.sub(r"(?<![^\W\d_])(?<!\x01)\b5(?=um)", "s", s)
    s = re.sub(r"(?<![\w\x01\x03])(?:[OolISgGBZ]{0,3}(?=[OolISgGBZ.]*\d))?" + NUMBER + r"(?![^\W\d_]*[\x02])", number, s)
    words = re.sub(r"[^a-z0-9\x01-\x04]+", " ", s.lower()).split()
    out: list[str] = []
    for w in words:
        if w[0] == "\x01":
            out += acts[int(w[1:-1])].lower().split()
        elif w[0] == "\x03":
            out.append("#" + numbers[int(w[1:-1])])
        else:
            out.append(w)
    return out


def near(a: str, b: str) -> bool:
    """One insertion, deletion, replacement or swap of neighbours apart at most (two replaced for long words)."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) <= 1 or len(d) == 2 and (d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def fragments(text: str) -> list[str]:
    """The normalised phrases of a label, parted by brackets and commas, without fillers at their ends."""
    out = []
    for piece in re.split(r"[(),;]", text):
        words = symbols(piece)
        while words and words[0] in FILLER:
            words.pop(0)
        while words and words[-1] in FILLER:
            words.pop()
        if words and not all(w[0] == "#" for w in words):
            out.append(" ".join(w.lstrip("#") for w in words))
    return out


def spellings(phrase: str) -> list[str]:
    """A name and its short forms: an act without its year, or with two digits of it."""
    act = re.fullmatch(r"((?:lei|lc)(?: complementar)? \d+) (?:19|20)?(\d\d)", phrase)
    return [phrase, act[1], f"{act[1]} {act[2]}"] if act else [phrase]


class Names:
    """The symbols of a list: kinds, courts and codes, with the automaton of their aliases.

    shapes: (natureza, tribunal, words before the label's number, words after it, words
    after the description's number) of the entries, distinct.
    """

    def __init__(self, shapes: list[tuple]):
        self.symbol: dict[str, str] = {}
        self.courts, self.codes, self.kinds = set(COURTS), set(CODES), {"SUM", "VIN", "ART"}
        for group in (KINDS, COURTS, CODES):
            for symbol, names in group.items():
                for name in names:
                    self.symbol[name] = symbol
        found: dict[str, str] = {}
        for nature, court, before, after, described in sorted(shapes, key=lambda r: tuple(x or "" for x in r)):
            if court and nature != "dispositivo":
                self.courts.add(court)
                long = fragments(described or "")[-1:] + (fragments(after or "") if nature == "sumula" else [])
                for name in [" ".join(symbols(court)), *long]:
                    found.setdefault(name, court)
            elif nature == "dispositivo" or nature not in ("sumula", "acordao"):
                phrases = fragments(after or "")
                if phrases:
                    code = next((self.symbol[x] for x in phrases if self.symbol.get(x) in self.codes), None) or "@" + phrases[0].replace(" ", "_")
                    self.codes.add(code)
                    for name in [*phrases, *fragments(described or "")]:
                        found.setdefault(name, code)
            if nature not in ("sumula", "acordao", "dispositivo") and (own := fragments(before or "")):
                kind = self.symbol.get(own[-1]) or "&" + own[-1].replace(" ", "_")
                self.kinds.update(kind.split())
                found.setdefault(own[-1], kind)
        for name, symbol in found.items():
            for x in spellings(name):
                self.symbol.setdefault(x, symbol)
        self.auto = ahocorasick.Automaton()
        self.known = frozenset([*self.kinds, *self.courts, *self.codes])
        self.places: dict[str, list[frozenset[str]]] = {}
        for name, symbol in self.symbol.items():
            self.auto.add_word(f" {name} ", (symbol, len(name)))
            words = frozenset(name.split()) - FILLER
            if symbol in self.courts | self.codes and len(words) > 1:
                self.places.setdefault(symbol, []).append(words)
        self.auto.make_automaton()
        self.words = frozenset(w for n in self.symbol for w in n.split()) | FILLER
        self.place_words = frozenset(w for sets in self.places.values() for words in sets for w in words)
        self.correctable = sorted(w for w in self.words if len(w) >= 4 and w.isalpha())
        self.corrections: dict[str, str] = {}

    def parts(self, words: list[str]) -> list[str]:
        """Aliases to symbols (longest first), fillers dropped."""
        line = f" {' '.join(words)} "
        out, at = [], 0
        for a, b, symbol in longest(self.auto, line):
            out += [w for w in line[at:a].split() if w not in FILLER]
            out += str(symbol).split()
            at = b
        out += [w for w in line[at:].split() if w not in FILLER]
        return out

    def corrected(self, word: str) -> str:
        """The alias word nearest to a word that is none; the word itself if there is none near."""
        if word in self.words or len(word) < 4 or not word.isalpha():
            return word
        if word not in self.corrections:
            if len(self.corrections) > REMEMBERED:
                self.corrections.clear()
            hits = [w for w in self.correctable if near(word, w)]
            self.corrections[word] = min(hits, key=lambda w: (w[0] != word[0], abs(len(w) - len(word)), w)) if hits else word
        return self.corrections[word]


class Canon:
    """The automaton and the token sets of a block of entries (id, natureza, tribunal, rotulo)."""

    def __init__(self, names: Names, entries: list[tuple[str, str, str | None, str | None]]):
        self.names = names
        self.ids: dict[str, str] = {}
        self.auto = ahocorasick.Automaton()
        self.by_number: dict[str, list[tuple[frozenset[str], str]]] = {}
        self.whole = ahocorasick.Automaton()
        forms: dict[str, str] = {}
        for id_, nature, court, label in sorted(entries, key=lambda e: (len(e[0]), e[0])):
            self.ids.setdefault(id_.lstrip("0"), id_)
            words = symbols(label or "")
            parts = names.parts(words)
            number = next((p for p in parts if p[0] == "#"), None)
            if number is None:  # named by its whole label
                if (name := " ".join(w for w in words if w not in FILLER)) and name not in self.whole:
                    self.whole.add_word(f" {name} ", (id_, len(name)))
                continue
            place = str(court) if nature == "sumula" else next((p for p in parts if p in names.codes), None)
            kind = "ART" if nature == "dispositivo" else next((p for p in parts if p in names.kinds), None)
            if nature == "acordao":
                own, tokens = [number], [number]
            elif nature == "sumula" and "VIN" in parts:
                own = [f"SUM VIN {number}", f"SUM {number} VIN", f"STF SUM VIN {number}", f"SUM VIN STF {number}", f"SUM VIN {number} STF", f"SUM {number} VIN STF"]
                tokens = ["SUM", "VIN", number]
            elif nature == "sumula":
                own, tokens = [f"SUM {number} {place}", f"{place} SUM {number}", f"SUM {place} {number}"], ["SUM", place, number]
            else:
                tokens = [x for x in (kind, number, place) if x]
                own = [" ".join(tokens), *([f"{place} {kind} {number}"] if place and kind else [])]
            for f in own:
                forms.setdefault(f, id_)
            self.by_number.setdefault(number, []).append((frozenset(tokens), id_))
        for f, id_ in forms.items():
            self.auto.add_word(f" {f} ", (id_, len(f)))
        for auto in (self.auto, self.whole):
            if len(auto):
                auto.make_automaton()

    def named(self, text: str) -> tuple[str, int, int, float, str]:
        """(way it was found, length of the mention, its place, score, id): the best mention of a text; way "-" for none."""
        names, words = self.names, symbols(text)
        for way in ("nome", "semelhanca"):
            parts = names.parts(words)
            held = [p for p in parts if p in names.known or p[0] == "#"]
            have = frozenset(held)
            if way == "semelhanca":
                break
            line = f" {' '.join(held)} "
            best = None
            for last, (id_, size) in self.auto.iter(line) if len(self.auto) else ():
                key = (size, size - last)
                if (best is None or key > best[0]) and not self.clash(frozenset(line[last - size : last].split()), have):
                    best = (key, last - size, id_)
            if best is not None:
                return way, best[0][0], best[1], 1.0, best[2]
            if len(self.whole):
                line = f" {' '.join(w for w in words if w not in FILLER)} "
                for last, (id_, size) in self.whole.iter(line):
                    if best is None or (size, size - last) > best[0]:
                        best = ((size, size - last), last - size, id_)
                if best is not None:
                    return "rotulo", best[0][0], best[1], 1.0, best[2]
            words = [names.corrected(w) for w in words]
        loose = frozenset(ABBREVIATED.get(w, w) for w in words) & names.place_words
        top: tuple[float, str] = (0.0, "")
        tied = False
        for number in sorted(p for p in have if p[0] == "#"):
            for tokens, id_ in self.by_number.get(number, ()):
                score = self.similarity(tokens, have, loose)
                if score >= MIN_SIMILARITY and not self.clash(tokens, have) and score >= top[0]:
                    tied = score == top[0] and id_ != top[1]
                    top = (score, id_) if score > top[0] else top
        if not top[0]:
            return "-", 0, 0, 0.0, "-"
        return ("empate", 0, 0, top[0], "-") if tied else ("semelhanca", 1, 0, top[0], top[1])

    def similarity(self, tokens: frozenset[str], have: frozenset[str], loose: frozenset[str]) -> float:
        """Shared symbols of all; a court or code that the text doesn't name as a symbol counts by the words of its name."""
        score = len(tokens & have) / len(tokens | (have - EXTRA))
        missing = tokens - have
        if not missing:
            return score
        if len(missing) > 1 or have & (self.names.courts | self.names.codes):
            return 0.0
        (place,) = missing
        return max((len(w & loose) / len(w | loose) for w in self.names.places.get(place, ())), default=0.0)

    def clash(self, tokens: frozenset, have: frozenset) -> bool:
        """A súmula of a court isn't meant where the text says it is binding, nor a binding one of another court."""
        courts = self.names.courts
        if "SUM" in tokens:
            if ("VIN" in tokens) != ("VIN" in have):
                return True
            return not (have & courts) <= (tokens | ({"STF"} if "VIN" in tokens else set()))
        if "ART" in tokens:
            return False
        if len(tokens) > 1:
            return False
        return "SUM" in have or "ART" in have

    def filled(self, value: str) -> tuple[str, int, int, float, str]:
        """The entry of a hand-filled value: its id, else the entry that it names."""
        id_ = self.by_id(value)
        return self.named(value) if id_ is None else ("id", 1, 0, 1.0, id_)

    def by_id(self, value: str) -> str | None:
        m = re.fullmatch(r"\s*(?:(?:id|doc|canonico)\b\s*[:#=.]?\s*)?([\d.]+)\s*", value, re.I)
        return self.ids.get(re.sub(r"\D", "", m[1]).lstrip("0")) if m else None


#: Symbols that may stand beside an entry's own: the court of a binding súmula.
EXTRA = frozenset(["STF"])


def entries_of(canon: DataFrame) -> DataFrame:
    return canon.where("id_canonico is not null").select("id_canonico", "natureza", "tribunal", "rotulo")


def shapes_of(canon: DataFrame, bound: int = MAX_NAMES) -> list[tuple]:
    """The distinct ways in which labels name kinds, courts and codes (see Names)."""
    number = r"^(.*?)(?<!\p{L})\d[\d.]*(?:[-/][\d.]+)*[ºª°]?(.*)$"
    head, tail = (F.regexp_extract("rotulo", number, k) for k in (1, 2))
    described = F.regexp_extract("descricao", number, 2)
    ruling = F.col("natureza") == "acordao"
    rows = canon.where("rotulo is not null").select("natureza", "tribunal", F.when(~ruling, head).alias("a"), F.when(~ruling, tail).alias("b"), F.when(ruling, F.element_at(F.split("descricao", ","), -1)).otherwise(described).alias("c")).distinct()
    made = [tuple(r) for r in rows.limit(bound + 1).collect()]
    if len(made) > bound:
        raise ValueError(f"the list names courts and codes in more than {bound} ways")
    return made


#: What is carried of the best mention in the text (t) and in the hand-filled column (f).
CARRIED = {"via": pa.string(), "size": pa.int32(), "at": pa.int32(), "score": pa.float64(), "id": pa.string()}
#: Ways of a mention in the order in which they win.
RANK = {"-": 0, "empate": 1, "semelhanca": 1, "rotulo": 2, "nome": 3, "id": 4}
NOTHING = ("-", 0, 0, 0.0, "-")


def map_mentions(df: DataFrame, canon: DataFrame, key: str = "citacao_id", text: str = "trecho", filled: str = "resolucao.id_canonico", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(key, trecho, id_canonico, via): the entry that each row names, or "-".

    via: how it was found: nome, rotulo (an entry without a number, by its whole label) and
    semelhanca in the text; id, filled_nome, filled_rotulo and filled_semelhanca in the
    hand-filled column; empate: equally similar entries, "-": nothing.
    """
    spark = df.sparkSession
    entries, names = entries_of(canon), shapes_of(canon)
    kind = df.schema[key].dataType.simpleString()
    empty = [F.lit(v).alias(f"{side}_{c}") for side in "tf" for c, v in zip(CARRIED, NOTHING)]
    out = df.select(F.col(key), F.col(text).alias("trecho"), F.col(filled).alias("_filled"), *empty)
    kinds = ("string", "int", "int", "double", "string")
    schema = f"`{key}` {kind}, trecho string, _filled string, " + ", ".join(f"{side}_{c} {k}" for side in "tf" for c, k in zip(CARRIED, kinds))
    head = [tuple(r) for r in entries.limit(max_entries + 1).collect()]
    if len(head) <= max_entries:
        out = out.mapInArrow(block_pass(spark.sparkContext.broadcast((names, head)), key, False), schema)
    else:
        shared_checkpoints(spark)
        n = -(-entries.count() // max_entries) * 2
        numbered = entries.withColumn("_block", F.pmod(F.xxhash64("id_canonico"), F.lit(n)))
        for k in range(n):  # one block at a time on the driver and the workers
            sent = spark.sparkContext.broadcast((names, [tuple(r) for r in numbered.where(F.col("_block") == k).drop("_block").collect()]))
            out = out.mapInArrow(block_pass(sent, key, True), schema).checkpoint()
            sent.unpersist()
    of_text, of_filled = ~F.col("t_via").isin("-", "empate"), ~F.col("f_via").isin("-", "empate")
    via = F.when(of_text, F.col("t_via")).when(F.col("f_via") == "id", "id").when(of_filled, F.concat(F.lit("filled_"), "f_via")).otherwise(F.when((F.col("t_via") == "empate") | (F.col("f_via") == "empate"), "empate").otherwise("-"))
    return out.select(key, "trecho", F.when(of_text, F.col("t_id")).when(of_filled, F.col("f_id")).otherwise("-").alias("id_canonico"), via.alias("via"))


_MADE: list[tuple] = []


def canon_of(sent) -> Canon:
    """The automata of a broadcast block, made once a worker."""
    value = sent.value
    if not _MADE or _MADE[0][0] is not value:
        _MADE[:] = [(value, Canon(Names(value[0]), value[1]))]
    return _MADE[0][1]


def block_pass(sent, key: str, both: bool):
    """Match a block of entries; a mention replaces one of an earlier block if it wins.

    both: look at the hand-filled column of every row, not only where the text names nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = canon_of(sent)
        seen: dict[tuple[str | None, str | None], tuple] = {}
        names = [key, "trecho", "_filled", *(f"{side}_{c}" for side in "tf" for c in CARRIED)]
        for batch in batches:
            made = []
            for text, filled, *before in zip(*(batch.column(k).to_pylist() for k in range(1, batch.num_columns))):
                if (text, filled) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    found = canon.named(text) if text and text.strip() else NOTHING
                    seen[text, filled] = found, canon.filled(filled) if filled and filled.strip() and (both or found[4] == "-") else NOTHING
                new = seen[text, filled]
                made.append((*better(tuple(before[:5]), new[0]), *better(tuple(before[5:]), new[1])))
            columns = zip(*made) if made else ((),) * 10
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, [*CARRIED.values()] * 2))], names=names)

    return run


def better(a: tuple, b: tuple) -> tuple:
    """The mention that wins, of two blocks: (via, size, at, score, id)."""
    if RANK[a[0]] != RANK[b[0]]:
        return a if RANK[a[0]] > RANK[b[0]] else b
    if RANK[a[0]] == 1:  # similar: the higher score, of equals none
        return max(a, b, key=lambda m: m[3]) if a[3] != b[3] else ("empate", 0, 0, a[3], "-")
    return max(a, b, key=lambda m: (m[1], -m[2], -len(m[4]), [-ord(c) for c in m[4]]))


def unmatched(mapped: DataFrame) -> DataFrame:
    """(trecho, linhas): what named nothing, with the number of rows."""
    return mapped.where("id_canonico = '-'").groupBy("trecho").agg(F.count(F.lit(1)).alias("linhas"))
