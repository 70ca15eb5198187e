"""Extraction: windows, a model that marks them, spans, and citations a document.

A model is anything that turns a frame of windows into the same rows with a column `raw`
(the marked text). `replayed` takes answers from a table; `rule_marked` marks by pattern
(native); `model_marked` runs a batched callable in Python workers, loaded once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.operators.tags import citations_of_windows
from citaria.operators.windows import DEFAULT_BUDGET, DEFAULT_OVERLAP, windows

# What the rule model marks. A name may follow any character but an ASCII letter, digit or underscore, so that
# what stands after garbled letters is found too.
RULE = (
    r"(?iu)(?:(?<![A-Za-z0-9_])(?:art(?:igo)?s?\.?)\s*\d[\d.]*[ºo°]?(?:,?\s*(?:caput|§\s*\d+[ºo°]?|inciso\s+[IVXLC]+|par[aá]grafo\s+[uú]nico))*,?\s*(?:d[aoe]\s+)?(?:Lei\s+n[.ºo°]*\s*[\d.]+/\d{2,4}|C[oó]digo\s+[A-ZÀ-Ú][\wÀ-ú]+(?:\s+[A-ZÀ-Ú][\wÀ-ú]+)?|CPC|CPP|CDC|CLT|CPM|CF|CC)"
    r"|(?<![A-Za-z0-9_])s[uú]mula(?:\s+vinculante)?(?:\s+n[.ºo°]*)?\s*\d+(?:\s*(?:do|da|/|-)\s*(?:STF|STJ|TST|TSE|STM))?"
    r"|(?<![A-Za-z0-9_])(?:REsp|AREsp|RE|HC|ADI|Rcl|RO|APL)\s*n?[.ºo°]*\s*\d[\d.]*\d(?:/[A-Z]{2})?)"
)


def replayed(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers from a table (keys, janela, raw); a window without one has a null answer."""
    return rows.join(answers.select(*keys, "janela", "raw"), [*keys, "janela"], "left")


def rule_marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", F.regexp_replace("texto", f"({RULE})", "<start>$1<end>"))


def model_marked(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 1000) -> DataFrame:
    """load() is called once a task and gives a function from texts to marked texts; its close(), if any, is called at the end."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    names, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at = names.index("texto")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, batch_size):
                    part = batch.slice(k, batch_size)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model(part.column(at).to_pylist()), pa.string())], names=[*names, "raw"])
        finally:
            getattr(model, "close", lambda: None)()

    return rows.mapInArrow(run, f"{kinds}, raw string")


def extract(docs: DataFrame, keys: list[str], text: str, marked: Callable[[DataFrame], DataFrame], budget: int = DEFAULT_BUDGET, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """(keys..., citacoes) of documents: windows, marks, spans in document offsets, repeats of overlaps dropped."""
    return citations_of_windows(marked(windows(docs, keys, text, budget, overlap)), keys, overlap)
