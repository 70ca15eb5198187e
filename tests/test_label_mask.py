"""The registered label masks keep whole examples up to the length of a training sequence."""

import __spark_entry__ as entry
from citaria.operators import train_data


def test_only_what_is_beyond_the_limit_is_cut(spark, tmp_path):
    rows = [(k, [("user", "Documento\n" + "p " * p), ("assistant", "r " * r)]) for k, (p, r) in enumerate([(150, 120), (1500, 1000), (10, 3000)])]
    spark.createDataFrame(rows, "exemplo_id bigint, messages array<struct<role:string,content:string>>").write.parquet(f"{tmp_path}/prata.parquet")
    got = {r.exemplo_id: (r.n, r.n_aprender) for r in entry.queries()["label_mask"](spark, str(tmp_path)).collect()}
    assert train_data.MAX_TOKENS == 2048 and got == {0: (270, 120), 1: (2048, 1000), 2: (2048, 2048)}
