"""An addition of this engine: texts that arrive in a folder are cut and resolved as a stream.

Stateless, so no watermark is needed; the corpus lookups are static. Each batch is a plan
like that of the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.operators.windows import DEFAULT_BUDGET, DEFAULT_OVERLAP, windows
from citaria.sources.files import stream_texts


def window_stream(spark, folder: str, budget: int = DEFAULT_BUDGET, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """(documento_id, janela, inicio, fim, n_texto, texto) of the texts of a folder, as they arrive."""
    return windows(stream_texts(spark, folder), ["documento_id"], "texto", budget, overlap)


def late_counts(citations: DataFrame, delay: str = "30 days", window: str = "1 day") -> DataFrame:
    """(janela, tipo, n) of a stream of citations by the time they were saved; rows later than the delay are dropped by the watermark."""
    timed = citations.withWatermark("gravado_em", delay)
    return timed.groupBy(F.window("gravado_em", window).alias("janela"), "tipo").agg(F.count(F.lit(1)).alias("n"))
