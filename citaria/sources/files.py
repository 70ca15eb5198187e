"""Readers and writers: text folders, corpora, golden sets, contracts, runs, JSON lines, submissions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from citaria.functions.text import model_slug
from citaria.operators.codec import encode_cell
from citaria.operators.train_data import stems

CITATION = "struct<inicio:int,fim:int,trecho:string,tipo:string,classificacao:string,confianca:double,resolucao:struct<id_canonico:string>>"
CONTRACT = f"documento_id string, citacoes array<{CITATION}>"
EXAMPLE = "documento_id string, inicio int, messages array<struct<role:string,content:string>>"
MANIFEST = "arquivo string, origem string, operacao string"
META = "name string, role string, family string, parameters string, slug string, batch_size int, lora string"
RUN_STAMP = "%Y%m%dT%H%M%S"
#: Files of a run folder that aren't contracts.
NOT_CONTRACTS = ("meta.json", "resumo.json")


#: Schema of the file source, which a stream needs beforehand.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


#: Options under which CSV keeps every character of a value, as Python's csv module does.
PLAIN_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path and the path in it; without a scheme it is a folder that all machines mount."""
    if (local := re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path)) is not None:
        return pafs.LocalFileSystem(), local[1]
    return pafs.FileSystem.from_uri(path)


def write_each(rows: DataFrame, folder: str, name: Column, content: Column) -> int:
    """One file a row, written by the tasks under a name of their own and then moved into place, so that a task may be repeated; gives the number of rows.

    folder must be shared by all executors; name may hold subfolders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = file_system(folder)
        made = set()
        for batch in batches:
            for name_, text in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/{name_}"
                if (parent := path.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write((text or "").encode())
                fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select(name.alias("name"), content.alias("content")).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_texts(texts: DataFrame, folder: str) -> int:
    """A .txt file for each row (documento_id, texto); null text makes an empty file."""
    return write_each(texts, folder, F.concat("documento_id", F.lit(".txt")), F.col("texto"))


def _texts(files: DataFrame) -> DataFrame:
    return files.select(stems(F.col("path")).alias("documento_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("texto"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(documento_id, texto): one row a .txt file of a folder, "" for an empty one; the id is the file's stem.

    Spark's scan leaves out empty files; their names come from the folder's listing.
    """
    full = _texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder))
    fs, root = file_system(folder)
    empty = [(f.base_name,) for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.size == 0 and f.extension == "txt"]
    if not empty:
        return full
    return full.unionByName(spark.createDataFrame(empty, "path string").select(stems(F.col("path")).alias("documento_id"), F.lit("").alias("texto")))


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """read_texts as a stream."""
    return _texts(spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.txt").load(folder))


def read_golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """A golden set in CSV with a header, with or without a byte order mark; all columns as text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def golden_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct documento_id of a golden set; empty if there is no such file."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], "documento_id string")
    return read_golden_csv(spark, path).select("documento_id").distinct()


def read_contracts(spark: SparkSession, folders: list[str] | str) -> DataFrame:
    """(run_ts, slug, documento_id, citacoes) of the contract files in run folders `<stamp>_<slug>`.

    Run metadata is skipped; a contract without an id has its file's stem.
    """
    df = spark.read.schema(CONTRACT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folders)
    df = df.select("*", F.col("_metadata.file_path").alias("_path")).where(~F.element_at(F.split("_path", "/"), -1).isin(*NOT_CONTRACTS))
    folder = F.element_at(F.split("_path", "/"), -2)
    return df.select(F.substring_index(folder, "_", 1).alias("run_ts"), F.regexp_replace(folder, "^[^_]*_", "").alias("slug"), F.coalesce("documento_id", stems(F.col("_path"))).alias("documento_id"), "citacoes")


def latest(runs: DataFrame, stamp: str = "run_ts") -> DataFrame:
    """All rows of the newest run stamp (a scalar subquery, so that partitions are pruned)."""
    newest = runs.agg(F.max(stamp).alias("_newest"))
    return runs.join(F.broadcast(newest), F.col(stamp) == F.col("_newest")).drop("_newest")


def with_metadata(runs: DataFrame, meta: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(slug, name, role, family, parameters) of runs: their own metadata, else the catalogue's by slug, else the slug."""
    own = meta.select("slug", *(F.col(c).alias(f"m_{c}") for c in ("name", "role", "family", "parameters")))
    cat = catalogue.select(model_slug(F.col("name")).alias("slug"), *(F.col(c).alias(f"c_{c}") for c in ("name", "role", "family", "parameters")))
    hit = runs.select("slug").distinct().join(own, "slug", "left").join(cat, "slug", "left")
    cols = [F.coalesce(f"m_{c}", f"c_{c}", *(["slug"] if c == "name" else [])).alias(c) for c in ("name", "role", "family", "parameters")]
    return hit.select("slug", *cols)


def read_jsonl(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """JSON lines; blank lines are skipped, an empty file is an error."""
    df = spark.read.schema(schema).json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def manifest_origins(manifest: DataFrame) -> DataFrame:
    """The distinct documents that training texts were made from."""
    return manifest.where("origem is not null").select(stems(F.col("origem")).alias("documento_id")).distinct()


def run_stamp(when: datetime | None = None) -> str:
    return (when or datetime.now()).strftime(RUN_STAMP)


def write_contracts(df: DataFrame, folder: str, run_ts: str, slug: str) -> str:
    """Contracts of a run, a pretty JSON file a document with nulls kept, in `<folder>/<stamp>_<slug>`; gives the path."""
    path = f"{folder}/{run_ts}_{slug}"
    _contract_files(df, path, F.col("documento_id"))
    return path


def write_runs(df: DataFrame, folder: str) -> int:
    """Contracts of several runs (run_ts, slug, documento_id, citacoes), each in its run's folder."""
    return _contract_files(df, folder, F.concat(F.concat_ws("_", "run_ts", "slug"), F.lit("/"), F.col("documento_id")))


def _contract_files(df: DataFrame, folder: str, name: Column) -> int:
    text = F.to_json(F.struct("documento_id", F.col("citacoes").cast(f"array<{CITATION}>").alias("citacoes")), {"pretty": "true", "ignoreNullFields": "false"})
    return write_each(df, folder, F.concat(name, F.lit(".json")), text)


def write_metadata(runs: DataFrame, folder: str) -> int:
    """meta.json of each run (run, and the columns of META that it has) in its folder."""
    kept = [c for c in ("name", "role", "family", "parameters", "slug", "batch_size", "lora") if c in runs.columns]
    return write_each(runs, folder, F.concat("run", F.lit("/meta.json")), F.to_json(F.struct(*kept), {"pretty": "true", "ignoreNullFields": "false"}))


def read_metadata(spark: SparkSession, folders: list[str] | str) -> DataFrame:
    """(run, META columns) of the meta.json files in run folders."""
    df = spark.read.schema(META).option("multiLine", True).option("pathGlobFilter", "meta.json").json(folders)
    return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), *df.columns)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def submission(contracts: DataFrame) -> DataFrame:
    """(documento_id, citacoes): one encoded cell a document."""
    cell = encode_cell(F.transform("citacoes", lambda c: F.struct(c["inicio"].alias("inicio"), c["fim"].alias("fim"), c["classificacao"].alias("classificacao"), c["confianca"].alias("confianca"), c["resolucao"]["id_canonico"].alias("id_canonico"))))
    return contracts.select("documento_id", cell.alias("citacoes"))


def write_submission(contracts: DataFrame, path: str) -> None:
    submission(contracts).write.mode("overwrite").options(**PLAIN_CSV).csv(path)


def write_held_out(golden: DataFrame, blocked: DataFrame, path: str) -> None:
    """The golden rows of documents that aren't blocked, as CSV."""
    golden.join(blocked.select("documento_id").distinct(), "documento_id", "left_anti").select(*golden.columns).write.mode("overwrite").options(**PLAIN_CSV).csv(path)


def evaluation_report(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., nivel, linha): a line a level, levels in numeric order."""
    line = F.format_string("nivel %s: score=%.4f macro_f1=%.4f tau=%.3f bonus=%.4f f1=%s/%s/%s", F.col("nivel").cast("string"), "score", "macro_f1", "tau", "b", *(F.round(f"f1_{c}", 3).cast("string") for c in ("real", "inventada", "incompleta")))
    return levels.select(*by, F.col("nivel").cast("int").alias("nivel"), line.alias("linha")).orderBy(*by, "nivel")


def write_evaluation(levels: DataFrame, finals: DataFrame, by: str, path: str) -> None:
    """One JSON row a model: final score and the details of its levels as a map."""
    f1s = F.map_from_arrays(F.array(*map(F.lit, ("real", "inventada", "incompleta"))), F.array("f1_real", "f1_inventada", "f1_incompleta"))
    detail = F.struct("macro_f1", F.map_filter(f1s, lambda _, v: v.isNotNull()).alias("f1_por_classe"), "tau", "s", "b", "score")
    maps = levels.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("nivel").cast("string"), detail))).alias("niveis"))
    finals.join(maps, by).select(by, F.struct("score_final", "niveis").alias("avaliacao")).write.mode("overwrite").json(path)


class SqliteCorpus(DataSource):
    """Table `documentos` of an SQLite file on a shared path; options path, columns (all if not given), natureza, parts, pushdown.

    spark.dataSource.register(SqliteCorpus); spark.read.format("sqlite_corpus").option(...).load()
    Filters on equality, membership and nulls run in SQLite (natureza and tribunal come with
    them); row ids are read in ranges; bytes that aren't UTF-8 are replaced. Python sources
    aren't told which columns a query needs: `columns` names them. Where the session's filter
    pushdown for Python sources is off (its default), Spark refuses a source that takes filters;
    pushdown must be "false" there, which read_corpus sees to.
    """

    ALL = {"id": "string", "natureza": "string", "tribunal": "string", "relator": "string", "texto": "string", "texto_len": "int"}

    @classmethod
    def name(cls) -> str:
        return "sqlite_corpus"

    def columns(self) -> list[str]:
        named = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if wrong := [c for c in named if c not in self.ALL]:
            raise ValueError(f"no such columns: {wrong}")
        return named or list(self.ALL)

    def schema(self) -> str:
        return ", ".join(f"{c} {self.ALL[c]}" for c in self.columns())

    def reader(self, schema) -> DataSourceReader:
        kind = PlainSqliteReader if self.options.get("pushdown", "true").lower() == "false" else SqliteReader
        return kind(self.options, self.columns())


class PlainSqliteReader(DataSourceReader):
    """Reads without Spark's filters, which Spark then applies itself; option natureza is selected in SQLite all the same."""

    def __init__(self, options, columns: list[str]):
        self.path, self.parts, self.columns = options["path"], int(options.get("parts", 8)), columns
        self.where: list[tuple[str, tuple]] = [("natureza = ?", (options["natureza"],))] if options.get("natureza") else []

    def connect(self):
        import sqlite3

        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        return con

    def partitions(self) -> list[InputPartition]:
        low, high = self.connect().execute("SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM documentos").fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, min(a + step, high + 1))) for a in range(low, high + 1, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b = partition.value
        sql = f"SELECT {', '.join(self.columns)} FROM documentos WHERE rowid >= ? AND rowid < ?" + "".join(f" AND {c}" for c, _ in self.where)
        numbers = [k for k, c in enumerate(self.columns) if c == "texto_len"]
        for row in self.connect().execute(sql, (a, b, *(v for _, values in self.where for v in values))):
            yield tuple(v if v is None or k in numbers else str(v) for k, v in enumerate(row))


class SqliteReader(PlainSqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters that mean the same in SQLite; gives back the others. Ids may be numbers there and aren't compared."""
        for f in filters:
            at = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if at not in ("natureza", "tribunal", "relator"):
                yield f
            elif isinstance(f, EqualTo):
                self.where.append((f"{at} = ?", (f.value,)))
            elif isinstance(f, In):
                self.where.append((f"{at} IN ({', '.join('?' * len(f.value))})", tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.where.append((f"{at} IS NOT NULL", ()))
            else:
                yield f


def read_corpus(spark: SparkSession, path: str, columns: str = "", natureza: str = "") -> DataFrame:
    """Table `documentos` of an SQLite file in any session; its filters run in SQLite where the session allows it, natureza always."""
    spark.dataSource.register(SqliteCorpus)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sqlite_corpus").options(path=path, columns=columns, natureza=natureza, pushdown=pushdown).load()


def document_key(*parts: str) -> Column:
    return F.concat_ws("#", *(F.col(p).cast("string") for p in parts))
