"""Problem 2: cut oversized items into pieces under a limit, at natural boundaries, with overlap.

Method: structure-tree packing. A text is a tree whose levels are sections (headings and
markup), paragraphs, lines and list items, sentences, clauses, words and, below all,
code points. Only nodes over the limit are parsed further; their parts are packed, and
neighbouring siblings that are whole are merged bottom-up as far as the limit goes. The
last part of an oversized node isn't merged with its next sibling, so that a cut stays at
the coarser boundary; it is only where it is shorter than a quarter of the limit.
A piece is a packed part with the last `overlap` code points before it.

Scale: the small run table is joined by broadcast (its size is checked), the size filter
runs in the JVM, and only oversized texts reach Python; no shuffle of texts.

Defined results: items at or under the limit, of null text, or of an unknown run or a
null or non-positive limit aren't cut; a null start gives null piece starts but offsets
within the item; an overlap that leaves no room for progress is taken as limit - 1;
a piece never begins at a combining mark if it can be helped; repeated rows are cut each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the run table that may be broadcast; a larger one is joined by shuffle.
MAX_RUNS = 100_000
#: A part shorter than the limit over this is merged with what follows, also across levels.
SCRAP = 4
#: Pieces in a record batch of the output, about.
BATCH_PIECES = 4_000

HEADING = re.compile(
    r"^(?:#{1,6}\s|<h[1-6][\s>]|(?:cap[ií]tulo|t[ií]tulo|se[cç][aã]o|anexo|parte)\s+[\divxlc]+|[IVXLC]{1,6}\s*[-–—.)]\s|(?:ementa|relat[oó]rio|voto|dispositivo|ac[oó]rd[aã]o|decis[aã]o|fundamenta[cç][aã]o)\s*:?\s*$)",
    re.I | re.M,
)
#: Levels from the coarsest: name, pattern, whether a match begins or ends a part.
LEVELS = (
    ("secao", HEADING, "begins"),
    ("bloco", re.compile(r"</(?:p|div|section|article|table|ul|ol|blockquote)>\s*", re.I), "ends"),
    ("paragrafo", re.compile(r"\r?\n[ \t\u00a0]*\r?\n\s*"), "ends"),
    ("linha", re.compile(r"\r?\n|[\r\u2028\u2029\x0b\x0c]|<br\s*/?>|</(?:li|tr)>", re.I), "ends"),
    ("frase", re.compile(r"[.!?…;:]+[\"'”’»)\]]*\s+|[。！？]"), "ends"),
    ("oracao", re.compile(r",\s+|\s[–—-]\s"), "ends"),
    ("palavra", re.compile(r"\s+|\u200b"), "ends"),
)


def children(text: str, a: int, b: int, level: int) -> list[tuple[int, int]]:
    _, pattern, side = LEVELS[level]
    cuts = [m.end() if side == "ends" else m.start() for m in pattern.finditer(text, a, b)]
    edges = [a, *(c for c in cuts if a < c < b), b]
    return [(x, y) for x, y in zip(edges, edges[1:]) if x < y]


def hard(text: str, a: int, b: int, limit: int) -> list[tuple[int, int, str]]:
    """Parts of code points, not before a combining mark or within CR LF unless there's no other place."""
    out = []
    while b - a > limit:
        cut = a + limit
        back = cut
        while back > a + 1 and (unicodedata.combining(text[back]) or text[back] in "\u200d\ufe0f" or text[back - 1] == "\u200d" or text[back - 1 : back + 1] == "\r\n"):
            back -= 1
        cut = back if back > a + 1 or limit == 1 else cut
        out.append((a, cut, "caractere"))
        a = cut
    out.append((a, b, "caractere"))
    return out


def pack(text: str, a: int, b: int, limit: int, level: int = 0) -> list[tuple[int, int, str]]:
    """Parts of text[a:b] under the limit, each with the kind of boundary that it ends at."""
    if b - a <= limit:
        return [(a, b, LEVELS[level - 1][0] if level else "fim")]
    while level < len(LEVELS):
        nodes = children(text, a, b, level)
        if len(nodes) > 1:
            break
        level += 1
    else:
        return hard(text, a, b, limit)
    parts: list[tuple[int, int, str]] = []
    open_ = False  # whether the last part may take the next node: it is made of whole nodes of this level, or a scrap
    for x, y in nodes:
        if y - x <= limit:
            if open_ and y - parts[-1][0] <= limit:
                parts[-1] = (parts[-1][0], y, LEVELS[level][0])
            else:
                parts.append((x, y, LEVELS[level][0]))
            open_ = True
            continue
        own = pack(text, x, y, limit, level + 1)
        if parts and open_ and (parts[-1][1] - parts[-1][0]) * SCRAP < limit and own[0][1] - parts[-1][0] <= limit:
            own[0] = (parts.pop()[0], *own[0][1:])
        own[-1] = (*own[-1][:2], LEVELS[level][0])
        parts += own
        open_ = (own[-1][1] - own[-1][0]) * SCRAP < limit
    return parts


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(offset, end, boundary it ends at) of each piece; one piece if the text is within the limit."""
    if len(text) <= limit:
        return [(0, len(text), "fim")]
    overlap = max(0, min(overlap, limit - 1))
    parts = pack(text, 0, len(text), limit - overlap)
    while len(parts) > 1 and parts[1][1] <= limit:  # the first piece has no overlap before it
        parts[:2] = [(0, parts[1][1], parts[1][2])]
    parts[-1] = (*parts[-1][:2], "fim")
    return [(a - overlap if a else 0, b, kind) for a, b, kind in parts]


def split_items(items: DataFrame, runs: DataFrame, key: str = "janela_id") -> DataFrame:
    """(key, posicao INT from 1, deslocamento INT, start INT, text STRING, fronteira STRING, n_pecas INT) of every oversized item."""
    limits = runs.where("run is not null").groupBy("run").agg(F.min("orcamento").alias("_limit"), F.min("sobreposicao").alias("_overlap"))
    if limits.limit(MAX_RUNS + 1).count() <= MAX_RUNS:
        limits = F.broadcast(limits)
    big = items.select(F.col(key), "run", F.col("start"), F.col("text")).join(limits, "run").where("_limit > 0 and char_length(text) > _limit")
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "posicao", "deslocamento", "start", "text", "fronteira", "n_pecas"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            rows: list[tuple] = []
            last = batch.num_rows - 1
            for k, (start, text, limit, overlap) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)))):
                pieces = cut(text, limit, overlap or 0)
                rows += [(k, p, a, None if start is None else start + a, text[a:b], f, len(pieces)) for p, (a, b, f) in enumerate(pieces, 1)]
                if rows and (len(rows) >= BATCH_PIECES or k == last):
                    at, *columns = (pa.array(c, t) for c, t in zip(zip(*rows), kinds))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns], names=names)
                    rows = []

    cols = big.select(F.col(key), "start", "text", "_limit", F.col("_overlap"))
    return cols.mapInArrow(run, f"`{key}` {kind}, posicao int, deslocamento int, start int, text string, fronteira string, n_pecas int")
