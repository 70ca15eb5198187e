"""Problem 8: find text that was decoded with a wrong encoding, and restore it.

Method: round-trip repair. A text is encoded again under a candidate legacy encoding and
decoded strictly as the intended one; the candidate whose garbling cost drops most is
accepted, and the step repeats for nested layers until no candidate lowers the cost.
Multi-byte sequences (UTF-8 read as a legacy encoding) are repaired sequence by sequence,
so a text that is garbled only in part is repaired in that part; single-byte mix-ups are
repaired word by word among words that hold a character that doesn't belong there.

What can't be restored (replacement characters, question marks in words, dropped control
characters) is found by the cost that remains: such rows come out with `restaurado` false.

Scale: a JVM filter keeps from Python the texts of ASCII without a question mark between
letters, which cost nothing; in Python the set of a text's characters and one search
decide whether it is looked at closely; there is no shuffle and nothing is collected.

Defined results: null, empty and blank texts are no cases; whole texts are read; repeated
rows come out each; other columns are ignored. Other scripts, symbols, entities, missing
accents and decomposed letters cost too little by themselves to be a case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy encodings under which UTF-8 may have been read: one byte a character, then several.
LEGACY_SINGLE = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859_15", "koi8_r", "cp1253", "cp1254", "cp858", "cp866", "iso8859_2", "iso8859_7", "iso8859_5", "cp1256", "cp1257", "cp775", "cp737")
LEGACY_MULTI = ("gbk", "shift_jis", "big5", "euc_kr", "euc_jp")
#: (read as, meant as) for one byte a character on both sides.
MIXED = tuple((a, b) for b in ("cp1252", "mac_roman", "cp850") for a in ("mac_roman", "cp1251", "cp437", "cp850", "cp1250", "cp1252", "koi8_r", "cp866", "cp1253", "cp1257", "iso8859_2", "iso8859_5", "iso8859_7") if a != b)
#: A repair must lower the cost by this much at least; a text is a case without a repair from this cost on.
MIN_DROP, LOST_COST = 1.0, 2.5

#: Characters that texts in Portuguese, Spanish and English hold by themselves.
LOWER, UPPER, MARKS = "áàâãéêíóôõúçñü", "ÁÀÂÃÉÊÍÓÔÕÚÇÑÜ", "ºª°§“”‘’–—…«»€¿¡´•\u00a0"
#: What a text must hold to be looked at closely: a character outside the above (ASCII and combining marks aside), or a letter where none belongs.
SUSPICIOUS = rf"[^\x00-\x7f{LOWER}{UPPER}{MARKS}̀-ͯ]|[a-z{LOWER}][{UPPER}]|[ÂÃ][^A-Za-zÀ-ÖØ-öø-ÿ]|[ÂÃÀ-ß]$|[A-Za-z][{MARKS}][A-Za-z]|â(?![a-zà-ÿ])|(?<![A-Za-zÀ-ÿ])Ã(?=[a-z])|Ã[ABCDF-HJ-LNPQRT-YÀ-Þ]|[a-z][âí]s(?![a-zà-ÿ])"

SEEN = re.compile(SUSPICIOUS)
#: Letters lost to question marks: one or more in a word (no address, which holds other signs), before a small letter.
LOST_LETTERS = re.compile(r"(?<![^\s(\[\"'“‘«])[A-Za-zÀ-ÿ\-]*[A-Za-zÀ-ÿ]\?{1,4}[a-zà-ÿ][A-Za-zÀ-ÿ?\-]*(?![^\s.,;:!)\]\"'”’»])")
#: An apostrophe or what is left of it before the s of an English genitive; Portuguese has few long words that end so.
GENITIVE = re.compile(r"[A-Za-z]{4,}í(?=s(?![a-zà-ÿ]))")
#: Texts of these characters alone hold nothing of the kind (but for `GENITIVE` and `LOST_LETTERS`); told from the set of a text's characters.
PLAIN = frozenset(map(chr, range(0x80))) | frozenset(LOWER) - {"â"}

UTF8_SEQUENCE = re.compile("[Â-ß][\u0080-¿]|à[\u00a0-¿][\u0080-¿]|[á-ï][\u0080-¿]{2}|ð[\u0090-¿][\u0080-¿]{2}|[ñ-ô][\u0080-¿]{3}")
#: The same after a no-break space was replaced by a plain one, which happens on the way.
SPACED_SEQUENCE, LONE_SPACED = re.compile("[ÂÃ] "), re.compile("(?<![A-ZÀ-Þ])Â ")
HIGH_RUN = re.compile("[^\x00-\x7f]+")
WORD = re.compile(r"[^ \t\r\n]+")


class ByteTable(dict):
    """For str.translate: the byte (as a code point) that a character has under an encoding; NUL if none."""

    def __missing__(self, code: int) -> int:
        self[code] = code if code < 0x80 else 0
        return self[code]


@lru_cache(maxsize=None)
def to_bytes(encoding: str) -> ByteTable:
    table = ByteTable()
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
    if encoding == "cp1252":  # undefined bytes, and Latin-1 readers, leave C1 controls
        for b in range(0x80, 0xA0):
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def swap_table(read_as: str, meant_as: str) -> dict[int, str]:
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(read_as))] = bytes([b]).decode(meant_as)
        except UnicodeDecodeError:
            pass
    return table


@lru_cache(maxsize=None)
def leads(encoding: str) -> frozenset[str]:
    """The characters that the first bytes of UTF-8 sequences become under an encoding."""
    return frozenset(chr(c) for c, b in to_bytes(encoding).items() if 0xC2 <= b <= 0xF4 and c >= 0x80)


@lru_cache(maxsize=None)
def odd_made_plain(read_as: str, meant_as: str) -> frozenset[str]:
    """The characters that don't belong in these texts but for which a swap puts letters or marks that do."""
    return frozenset(chr(c) for c, m in ((ord(c) if isinstance(c, str) else c, m) for c, m in swap_table(read_as, meant_as).items()) if kind(chr(c)) in "uxXzymb" and kind(m) in "lum")


@lru_cache(maxsize=8192)
def kind(c: str) -> str:
    """a: ASCII letter, d: digit, s: space, p: other ASCII, l/u: expected accented letter, m: expected mark,
    n: combining mark, x: other Latin letter, X: its capital, z: other script, y: symbol, b: control or lost."""
    if c < "\x80":
        return "a" if c.isalpha() else "d" if c.isdigit() else "s" if c.isspace() else "p"
    if c in LOWER:
        return "l"
    if c in UPPER:
        return "u"
    if c in MARKS:
        return "m"
    if c == "�" or "\x80" <= c <= "\x9f":
        return "b"
    cat = unicodedata.category(c)
    if cat[0] == "M":
        return "n"
    if cat[0] == "L":
        name = unicodedata.name(c, "")
        if name.startswith("LATIN"):
            return "X" if cat == "Lu" else "x"
        return "y" if c == "µ" else "z"
    return "y"


LETTERS = frozenset("alunxXz")
LATIN = frozenset("alunxX")


def cost(text: str, lone: bool = True) -> float:
    """How garbled a text looks. Only characters beyond ASCII, by their neighbours, cost anything.

    lone: count letters that UTF-8 sequences leave when their other characters were dropped.
    """
    total = 0.0
    n = len(text)
    for run in HIGH_RUN.finditer(text):
        for i in range(run.start(), run.end()):
            c = text[i]
            k = kind(c)
            if k == "n":
                continue
            if k == "l":  # no word ends in this one, nor in it and an s: what is left of a dash or a quotation mark
                if lone and c == "â" and not (i and text[i - 1].isupper()):
                    nxt = i + 2 if text[i + 1 : i + 2] == "s" else i + 1
                    if nxt >= n or kind(text[nxt]) not in LATIN:
                        total += 2.5
                continue
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < n else " "
            kb, ka = kind(before), kind(after)
            if k == "b":
                total += 3
            elif k in "uX":
                if before.islower() and kb in LATIN and kb != "n":
                    total += 2.5
                elif c in "ÃÂ" and (ka not in LATIN or ka == "n") and not (before.isupper() and kb in LATIN):
                    total += 2.5
                elif c == "Ã" and kb not in LATIN and after.islower():
                    total += 2.5
                elif after.islower() and kb in LATIN and kb != "n" and not before.isupper():
                    total += 2
                elif lone and c == "Ã" and before != "Ç" and after in "ABCDFGHJKLNPQRTUVWXYÃÁÀÂÉÊÍÓÔÕÚ":
                    total += 2.5  # in capitals: no such syllable, the second byte was dropped
                elif k == "X":
                    total += 0.1 if kb in LATIN or ka in LATIN and after.isupper() else 0.3 if ka in LATIN else 1
                elif ka in "my" and after not in "”’»…–—\u00a0":
                    total += 1
            elif k == "x":
                if c == "ì" and kb not in LATIN and ka in LATIN or c == "î" and kb in LATIN and ka not in LATIN:
                    total += 2.5  # no word begins or ends so: quotation marks
                    continue
                total += 1.2 if ka in "my" or kb in "my" and before not in "’‘“« " else 0.4
            elif k == "z":
                if kb in LATIN and kb != "n" or ka in LATIN and ka != "n" or ka == "y" or kb == "y":
                    total += 2.5
                elif ka != "z" and kb != "z":
                    total += 1
            elif k == "m":
                if c == "\u00a0":
                    total += 0.3 if kb == "u" else 0
                elif c in "ºª°":
                    total += 1.5 if kb in LATIN and ka in LATIN else 0
                elif c == "’" or c == "‘":
                    total += 0
                elif c == "¿" or c == "¡":
                    total += 0 if ka in LETTERS and kb not in LETTERS else 1.5
                elif kb in LATIN and ka in LATIN:
                    total += 1.5
                elif c == "€" and kb in LATIN:
                    total += 1.5
                elif c == "§":
                    total += 1.5 if kb in LATIN or ka in LATIN else 0
                elif c in "´•":
                    total += 1 if kb in LATIN or ka in LATIN else 0.1
            else:
                if c in "​‌‍﻿­⁠":
                    total += 0.4 if c == "­" and kb in "uX" else 0.02
                elif c in "²³¹" and kb in "ad" and ka not in LETTERS:
                    total += 0.1
                elif c in "¼½¾" and (kb in "ds" and ka not in LETTERS):
                    total += 0.1
                elif kb in LATIN or ka in LATIN or kb in "my" and not before.isspace() and c < "☀" or ka == "m" and after != " " and c < "☀":
                    total += 2.5 if c < "☀" else 0.2
                else:
                    total += 0.1 if c >= "☀" or c in "©®™×÷±" else 0.6
    if n and "ís" in text and (found := GENITIVE.findall(text)) and len(found) == sum(kind(c) in "lu" for run in HIGH_RUN.findall(text) for c in run if c not in "ìî"):
        total += 2.5 * len(found)  # the only accents of the text
    if "?" in text:
        total += sum(2.5 if "??" in w else 1.3 for w in LOST_LETTERS.findall(text))
    return total


def from_utf8_single(text: str, encoding: str) -> tuple[str, int]:
    """Decode each complete UTF-8 sequence that shows when text is encoded under a one-byte encoding; and how many."""
    raw = text.translate(to_bytes(encoding))
    out, at = [], 0
    for m in UTF8_SEQUENCE.finditer(raw):
        try:
            made = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[at : m.start()], made]
        at = m.end()
    out.append(text[at:])
    made, found = "".join(out), len(out) // 2
    if encoding == "cp1252":
        made, spaced = (SPACED_SEQUENCE if found else LONE_SPACED).subn(lambda m: "à " if m.group()[0] == "Ã" else "\u00a0", made)
        found += spaced
    return made, found


def from_utf8_multi(text: str, encoding: str) -> str:
    def back(m: re.Match) -> str:
        try:
            return m.group().encode(encoding).decode("utf-8")
        except UnicodeError:
            return m.group()

    return HIGH_RUN.sub(back, text)


def swapped(text: str, read_as: str, meant_as: str) -> str:
    """The whole text back in the meant encoding; characters that the other doesn't have stay."""
    return text.translate(swap_table(read_as, meant_as))


def swapped_in_part(text: str, read_as: str, meant_as: str) -> str:
    table = swap_table(read_as, meant_as)

    def back(m: re.Match) -> str:
        w = m.group()
        if w.isascii() or not (now := cost(w)) or now < 1:
            return w
        made = w.translate(table)
        return made if cost(made) < now else w

    return WORD.sub(back, text)


def believable(text: str, made: str) -> bool:
    """Whether most of the characters that a swap changed became letters and marks of these languages."""
    new = [b for a, b in zip(text, made) if a != b]
    return sum(kind(c) in "lum" for c in new) >= 0.8 * len(new)


def step(text: str, now: float) -> tuple[float, str, str]:
    """The best single layer back: (cost, text, name of the layer).

    Among one-byte readings of UTF-8 the one that decodes most sequences wins (complete
    sequences don't arise by chance), of equals and elsewhere the one that costs least.
    """
    best, most, chars = (now, text, ""), 0, set(text)
    for e in LEGACY_SINGLE:
        if leads(e).isdisjoint(chars) and not (e == "cp1252" and "Â" in chars):
            continue
        made, found = from_utf8_single(text, e)
        if found and found >= most and (c := cost(made)) < (now - 1e-9 if e == "cp1252" else now / 2) and (found > most or c < best[0] - 1e-9):
            best, most = (c, made, f"utf_8<{e}"), found
    if any("⺀" <= c <= "힣" or "｡" <= c <= "ﾟ" for c in text):
        for e in LEGACY_MULTI:
            made = from_utf8_multi(text, e)
            if made != text and (c := cost(made)) < best[0] - 1e-9:
                best = (c, made, f"utf_8<{e}")
    if best[2]:
        return best
    base = now = cost(text, False)
    for a, b in MIXED:
        if odd_made_plain(a, b).isdisjoint(chars) and not GENITIVE.search(text):
            continue
        for way in (swapped, swapped_in_part):
            made = way(text, a, b)
            if made != text and (c := cost(made, False)) < now - 0.5 and c <= base / 2 and believable(text, made):
                now, best = c, (cost(made), made, f"{b}<{a}")
    return best


def suspicious(text: str | None) -> bool:
    if not text:
        return False
    if (not PLAIN.issuperset(text) or "ís" in text) and SEEN.search(text) is not None:
        return True
    return "?" in text and LOST_LETTERS.search(text) is not None


def repair(text: str | None) -> tuple[bool, str | None, list[str], float]:
    """(whether it is a case, the text as far as restored, layers from the outermost, cost that remains)."""
    if not suspicious(text):
        return False, text, [], 0.0
    first = now = cost(text)
    layers, made = [], text
    while now >= MIN_DROP:  # ends: the cost drops with every layer
        c, better, name = step(made, now)
        if not name:
            break
        now, made = c, better
        layers.append(name)
    if layers and first - now < MIN_DROP:
        return first >= LOST_COST, text, [], first
    return bool(layers) or now >= LOST_COST, made, layers, now


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, camadas ARRAY<STRING>, restaurado BOOLEAN, texto STRING, custo DOUBLE): the affected rows.

    restaurado: nothing garbled is left; texto: the text as far as it could be restored.
    """
    type_ = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [repair(t) for t in batch.column(1).to_pylist()]
            hit = [k for k, d in enumerate(done) if d[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(hit, pa.int64())),
                    pa.array([done[k][2] for k in hit], pa.list_(pa.string())),
                    pa.array([bool(done[k][2]) and done[k][3] < 1 for k in hit], pa.bool_()),
                    pa.array([done[k][1] for k in hit], pa.string()),
                    pa.array([round(done[k][3], 3) for k in hit], pa.float64()),
                ],
                names=[key, "camadas", "restaurado", "texto", "custo"],
            )

    seen = df.select(F.col(key), F.col(text)).where((F.octet_length(text) > F.char_length(text)) | F.col(text).rlike(r"[A-Za-z]\?+[a-z]"))
    return seen.mapInArrow(run, f"`{key}` {type_}, camadas array<string>, restaurado boolean, texto string, custo double")
