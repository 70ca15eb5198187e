"""Problem 4: several values packed in one field, one value a row, positions kept.

Method: a parsing expression grammar. Alternatives are ordered (quoted, bracketed, bare),
the first that fits wins, and a malformed quote makes the parser backtrack to the bare
alternative and set an error flag instead of losing the rest of the cell.

    cell    <- blank* separator* (value (separator+ value)*)? separator*
    value   <- quoted / bracketed / bare
    quoted  <- '"' ('""' / !'"' any)* '"' &end  /  "'" ("''" / !"'" any)* "'" &end
    bracketed <- '[' cell ']' / '(' cell ')' / '{' cell '}'
    bare    <- (!separator any)+                            ids
    bare    <- field (',' field){n-1}                       records of n fields
    field   <- quoted / '[' (!closing any)* ']' &end / (!separator !',' any)*
    end     <- blank* (separator / closing bracket / end of the cell)

Scale: a narrow Arrow map over the two columns it needs; a cell is parsed in one pass
without recursion on brackets; quotes that have no end and the last place of each closing
bracket are remembered, so that backtracking stays linear.

Defined results: null, empty, blank and "-" cells have no values; empty pieces and a
lone "-" between values are no values; repeated values count each time; positions count
from 1 within the cell; a quote or bracket without its end is left out of the value,
which has `erro` aspas or colchete and still counts; a record with too few or too many fields, or an id that isn't
digits only, comes out with `erro` set and doesn't count among the values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSING = {"[": "]", "(": ")", "{": "}"}
#: Separators of a list of ids: a run of these, or a lone "e" between values.
ID_SEPARATOR = re.compile(r"(?:[\s|;:,/+–—]|-|(?<![^\W_])e(?![^\W_])|(?<![^\W_])and(?![^\W_]))+")
#: Separators of a list of records; a comma only where a record is complete.
RECORD_SEPARATOR = re.compile(r"(?:[\s|;]|(?<=[|;\s])-(?=[|;\s]|$)|^-(?=[|;\s]))+")
RECORD_FIELDS, RECORD_KEPT = 5, 4


class Peg:
    """One cell. Every rule takes a position and gives (position after, value) or None."""

    def __init__(self, text: str, fields: int = 1):
        self.text, self.n, self.fields = text, len(text), fields
        self.separator = ID_SEPARATOR if fields == 1 else RECORD_SEPARATOR
        self.open: set[str] = set()
        self.last_closing = {c: text.rfind(c) for c in CLOSING.values()}
        self.values: list[tuple[str, str | None]] = []

    def skip(self, at: int, comma: bool = True) -> int:
        while at < self.n:
            m = self.separator.match(self.text, at)
            if m and m.end() > at:
                at = m.end()
            elif comma and self.text[at] == ",":
                at += 1
            else:
                break
        return at

    def ends(self, at: int, inside: str) -> bool:
        while at < self.n and self.text[at].isspace():
            at += 1
        return at >= self.n or self.text[at] in ",;|" or self.text[at] == inside or self.separator.match(self.text, at) is not None or self.text[at - 1].isspace()

    def quoted(self, at: int, inside: str = "") -> tuple[int, str] | None:
        q = self.text[at] if at < self.n else ""
        if q not in ('"', "'") or not q or q in self.open:
            return None
        out, k = [], at + 1
        while (e := self.text.find(q, k)) >= 0:
            out.append(self.text[k:e])
            if self.text.startswith(q, e + 1):
                out.append(q)
                k = e + 2
                continue
            return (e + 1, "".join(out)) if self.ends(e + 1, inside) else None
        self.open.add(q)
        return None

    def field(self, at: int, inside: str) -> tuple[int, str, bool]:
        """(position after, value, whether a quote has no end)."""
        k = at
        while k < self.n and self.text[k] in " \t\u00a0":
            k += 1
        if (got := self.quoted(k, inside) or self.bracketed(k, inside)) is not None:
            end = got[0]
            while end < self.n and self.text[end] == " " and self.text[end + 1 : end + 2] == ",":
                end += 1
            return end, got[1].strip(), False
        while k < self.n and self.text[k] not in ",|;\r\n\t" and self.text[k] != inside:
            k += 1
        value = self.text[at:k].strip()
        broken = value[:1] in ('"', "'")
        return k, value.lstrip("\"'").strip() if broken else value, broken

    def bracketed(self, at: int, inside: str) -> tuple[int, str] | None:
        """A bracketed field of a record: what stands between the brackets, separators included, within one line and record."""
        if at >= self.n or self.text[at] not in CLOSING or self.last_closing[CLOSING[self.text[at]]] < at:
            return None
        e = self.text.find(CLOSING[self.text[at]], at)
        return (e + 1, self.text[at + 1 : e]) if not set("|\r\n").intersection(self.text[at:e]) and self.ends(e + 1, inside) else None

    def bare(self, at: int, inside: str) -> tuple[int, str, str | None]:
        if self.fields == 1:
            k = at
            while k < self.n and self.text[k] != inside and not ((m := self.separator.match(self.text, k)) and m.end() > k):
                k += 1
            k = max(k, at + 1)
            return k, self.text[at:k].strip(), None
        parts, k, broken = [], at, False
        while True:
            k, part, wrong = self.field(k, inside)
            parts.append(part)
            broken |= wrong
            if len(parts) == self.fields or k >= self.n or self.text[k] != ",":
                break
            k += 1
        value, wrong = self.record(parts)
        return max(k, at + 1), value, wrong or ("aspas" if broken else None)

    def record(self, parts: list[str]) -> tuple[str, str | None]:
        wrong = "campos" if len(parts) != self.fields else None if re.fullmatch(r"\d+", parts[0]) and re.fullmatch(r"\d+", parts[1]) else "posicao"
        return ",".join(parts[:RECORD_KEPT]), wrong

    def emit(self, value: str, wrong: str | None) -> None:
        value = value.strip()
        if value in ("", "-"):
            return
        if self.fields == 1 and wrong is None and not (value.isascii() and value.isdigit()):
            wrong = "valor"
        self.values.append((value, wrong))

    def cell(self) -> None:
        at, inside, unclosed, outer = 0, "", False, []
        while (at := self.skip(at)) < self.n:
            c = self.text[at]
            if c == inside:
                self.flag(unclosed)
                inside, unclosed = outer.pop()
                at += 1
            elif (got := self.quoted(at, inside)) is not None:
                self.inner(got[1])
                at = got[0]
            elif c in CLOSING and not (self.fields > 1 and outer):
                if self.last_closing[CLOSING[c]] > at:
                    outer.append((inside, unclosed))
                    inside, unclosed = CLOSING[c], False
                else:
                    unclosed = True
                at += 1
            elif c in ('"', "'") and c in self.open:  # malformed: go on without the quote
                k, value, wrong = self.bare(at + 1, inside)
                self.emit(value.strip("\"'"), wrong or "aspas")
                at = k
            else:
                at, value, wrong = self.bare(at, inside)
                self.emit(value, wrong)
        while outer:
            self.flag(unclosed)
            inside, unclosed = outer.pop()
        self.flag(unclosed)

    def flag(self, unclosed: bool) -> None:
        if unclosed and self.values:
            value, wrong = self.values[-1]
            self.values[-1] = (value, wrong or "colchete")

    def inner(self, text: str) -> None:
        """What a quoted piece holds: a value, or a list of values of its own."""
        if self.fields == 1 and text.strip().isdigit():
            self.emit(text, None)
        elif text.strip():
            part = Peg(text.strip(), self.fields)
            part.cell()
            self.values += part.values


def unpack(text: str | None, fields: int = 1) -> list[tuple[int, str, str | None]]:
    """(position, value, error) of each piece of a cell; pieces with an error have position 0."""
    if text is None or not text.strip():
        return []
    peg = Peg(text.strip(), fields)
    peg.cell()
    out, k = [], 0
    for value, wrong in peg.values:
        good = wrong in (None, "aspas", "colchete")
        k += good
        out.append((k if good else 0, value, wrong))
    return out


def unpack_column(df: DataFrame, key: str, cell: str, fields: int = 1) -> DataFrame:
    """(key, posicao INT, valor STRING, n_valores INT, erro STRING), one row a piece of each cell."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                pieces = unpack(text, fields)
                n = sum(p[0] > 0 for p in pieces)
                at += [k] * len(pieces)
                rows += [(*p[:2], n, p[2]) for p in pieces]
            pos, val, n_, err = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(val, pa.string()), pa.array(n_, pa.int32()), pa.array(err, pa.string())],
                names=[key, "posicao", "valor", "n_valores", "erro"],
            )

    clean = df.select(F.col(key), F.col(cell)).where(F.col(cell).isNotNull() & ~F.trim(cell).isin("", "-"))
    return clean.mapInArrow(run, f"`{key}` {kind}, posicao int, valor string, n_valores int, erro string")


def packed_values(submission: DataFrame, goldenset: DataFrame) -> DataFrame:
    """(tabela, linha_id, posicao, valor, n_valores, erro) of every piece of both tables."""
    a = unpack_column(submission, "linha_id", "citacoes", RECORD_FIELDS).withColumn("tabela", F.lit("submission"))
    b = unpack_column(goldenset, "linha_id", "id_canonico").withColumn("tabela", F.lit("goldenset"))
    return a.unionByName(b).select("tabela", "linha_id", "posicao", "valor", "n_valores", "erro")


def packed_found(submission: DataFrame, goldenset: DataFrame) -> DataFrame:
    """The values of every cell that holds two or more."""
    return packed_values(submission, goldenset).where("posicao > 0 and n_valores >= 2").select("tabela", "linha_id", "posicao", "valor")
