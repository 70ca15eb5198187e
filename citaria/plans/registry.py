"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citaria.operators import packed
from citaria.plans import file_queries, score_queries, span_queries, text_queries
from citaria.session import ship_package, table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return packed.packed_found(table(spark, sf, "submission"), table(spark, sf, "goldenset"))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return packed.packed_values(table(spark, sf, "submission"), table(spark, sf, "goldenset"))


#: The two columns' values by regular expressions alone: an independent way to the same rows on these tables.
P4_SQL = r"""
WITH s AS (SELECT linha_id, regexp_extract_all(coalesce(citacoes, ''), '[0-9]+ ?, ?[0-9]+ ?, ?[A-Za-z]+ ?, ?(?:"{1,2}[^"]*"{1,2}|-|[0-9]+) ?,') AS l FROM submission),
g AS (SELECT linha_id, regexp_extract_all(coalesce(id_canonico, ''), '[0-9]+') AS l FROM goldenset),
a AS (SELECT 'submission' AS tabela, linha_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS posicao FROM s WHERE len(l) > 1)
SELECT tabela, linha_id, posicao::INT AS posicao, regexp_replace(regexp_replace(regexp_replace(v, ' ?, ?', ',', 'g'), '"', '', 'g'), ',$', '') AS valor FROM a
UNION ALL SELECT 'goldenset', linha_id, unnest(range(1, len(l) + 1))::INT, unnest(l) FROM g WHERE len(l) > 1
"""

QUERIES = {"p4_found": p4_found, "p4_values": p4_values, **score_queries.QUERIES, **span_queries.QUERIES, **text_queries.QUERIES, **file_queries.QUERIES}
ORACLE = {"p4_found": P4_SQL, **score_queries.ORACLE, **span_queries.ORACLE, **text_queries.ORACLE, **file_queries.ORACLE}
