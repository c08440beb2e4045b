"""Reading the driver's tables, and building small ones from values."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def documents_as(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """(row, text) of all documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col(text).alias("text"))


def turns_as(spark: SparkSession, sf_dir: str, role: str = "user") -> DataFrame:
    """(row, text) of all turns of a role."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == role).select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text")


def spread(base: DataFrame, rows: list[tuple], schema: str, id: str, behind: tuple[str, ...] = (), sep: str = " ", numbers: list[int] | None = None) -> DataFrame:
    """The rows of a table, base(row, text), each with the columns of one of `rows`, those dealt out in turn.

    The column `id` is the table's row, and columns in `behind` are followed by its text, so that a rule that is sought
    meets a case and the words of the table. numbers: the turn of each of rows, where several have the same.
    """
    numbers = list(range(len(rows))) if numbers is None else numbers
    cases = values(base.sparkSession, [(*r, n) for r, n in zip(rows, numbers, strict=True)], f"{schema}, _n int")
    x = base.withColumnRenamed("text", "_text").join(F.broadcast(cases), F.pmod("row", F.lit(max(numbers) + 1)) == F.col("_n"))
    column = lambda c: F.col("row") if c == id else F.when(F.col(c).isNotNull(), F.concat(c, F.lit(sep), F.coalesce("_text", F.lit("")))) if c in behind else F.col(c)
    return x.select(*(column(c).alias(c) for c in cases.columns[:-1]))


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own only where everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
        base = _OWN[app]
    return base.rstrip("/")


def version(spark: SparkSession, path: str) -> str:
    """Names a table's files with their sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(at)
    said = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:32]


def publish(spark: SparkSession, own: str, path: str) -> None:
    """Renames the folder `own`, written whole, to path, unless another run has put one there meanwhile."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (own, path))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)


def literal(x: object) -> str:
    """A value as an SQL literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def sql_values(rows: list[tuple], name: str, columns: str) -> str:
    """`(VALUES ...) AS name(columns)` for an SQL oracle."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS {name}({columns})"


DOCUMENTS_SQL = "SELECT doc_id AS row, text FROM documents"
SOURCES_SQL = "SELECT doc_id AS row, source AS text FROM documents"
USER_SQL = "SELECT conv_id * 1000 + turn AS row, text FROM conversations WHERE role = 'user'"
ASSISTANT_SQL = "SELECT conv_id * 1000 + turn AS row, text FROM conversations WHERE role = 'assistant'"


def spread_sql(base: str, rows: list[tuple], name: str, columns: str, id: str, behind: tuple[str, ...] = (), sep: str = " ", numbers: list[int] | None = None) -> str:
    """`spread` for an SQL oracle, as `(SELECT ...) AS name`."""
    numbers = list(range(len(rows))) if numbers is None else numbers
    column = lambda c: "row" if c == id else f"_v.{c} || {literal(sep)} || coalesce(_b.text, '')" if c in behind else f"_v.{c}"
    named = ", ".join(f"{column(c)} AS {c}" for c in columns.split(", "))
    return f"(SELECT {named} FROM ({base}) _b JOIN {sql_values([(*r, n) for r, n in zip(rows, numbers, strict=True)], '_v', columns + ', _n')} ON row % {max(numbers) + 1} = _n) AS {name}"
