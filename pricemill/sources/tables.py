"""Readers and writers of the panel's tables, and the adapter from sales tables to a movement table."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.functions.columns import money
from pricemill.functions.workers import let_workers_import

MOVEMENT = T.StructType([
    T.StructField("store", T.IntegerType()), T.StructField("upc", T.LongType()), T.StructField("week", T.IntegerType()), T.StructField("move", T.DoubleType()),
    T.StructField("qty", T.DoubleType()), T.StructField("price", T.DoubleType()), T.StructField("sale", T.StringType()), T.StructField("profit", T.DoubleType()), T.StructField("ok", T.ByteType()),
])
PRODUCTS = T.StructType([
    T.StructField("com_code", T.IntegerType()), T.StructField("upc", T.LongType()), T.StructField("descrip", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("case", T.IntegerType()), T.StructField("nitem", T.LongType()),
])
# What counts as missing in the raw exports.
NULL_TOKENS = ("", ".", "NA", "N/A")


class SchemaError(ValueError):
    """A table lacks a column that it must have."""


def require_columns(df: DataFrame, names: list[str], source: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise SchemaError(f"{source} lacks {', '.join(missing)}")


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed columns of a Latin-1 file by header name; headers are trimmed and lower-cased, null tokens become null."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    require_columns(raw, schema.names, path)
    # a null token fails try_cast anyway, but stays text in text columns
    value = lambda f: F.when(~F.trim(F.col(f.name)).isin(*NULL_TOKENS), F.trim(F.col(f.name)))
    return raw.select(*(value(f).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def checked_csv(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed rows, damaged records) of Latin-1 files with the same header.

    A record is damaged if it has more or fewer fields than the header (reason columns), a value that is neither a null token nor
    of its column's type (type:<column>), or none in a required column (missing:<column>). Damaged records are
    (file, line, reasons): the line as it stands, and all that is wrong with it; they are in no typed row. Both
    tables come from one reading, so every record that isn't blank or a header is in one of them. A field in
    quotes may hold the separator but no end of line.
    """
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    header = [c.strip().lower() for c in raw.columns]
    require_columns(raw.toDF(*header), schema.names, path)
    lines = spark.read.schema("line string").option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").option("escape", "\x02").csv(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "line")
    names = [f"f{i}" for i in range(len(header))]
    fields = F.from_csv("line", ", ".join(f"{n} string" for n in names) + ", damage string", {"columnNameOfCorruptRecord": "damage", "mode": "PERMISSIVE"})
    own = lines.withColumn("__r", fields).where(F.array_join(F.array(*(F.lower(F.trim(f"__r.{n}")) for n in names)), ",") != ",".join(header))
    place = {name: names[header.index(name)] for name in schema.names}
    text = {n: F.trim(F.col(f"__r.{p}")) for n, p in place.items()}
    value = {n: F.when(~t.isin(*NULL_TOKENS), t) for n, t in text.items()}
    typed = {f.name: value[f.name].try_cast(f.dataType) for f in schema.fields}
    found = [F.when(F.col("__r.damage").isNotNull(), F.lit("columns"))]
    found += [F.when(value[n].isNotNull() & typed[n].isNull(), F.lit(f"type:{n}")) for n in schema.names]
    found += [F.when(value[n].isNull(), F.lit(f"missing:{n}")) for n in required]
    reasons = F.filter(F.array(*found), lambda r: r.isNotNull())
    # of a record of the wrong width no field is in a known place, so nothing else is said of it
    reasons = F.when(F.col("__r.damage").isNotNull(), F.array(F.lit("columns"))).otherwise(reasons)
    judged = own.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).select(*(c.alias(n) for n, c in typed.items())), judged.where(F.size("reasons") > 0).select("file", "line", "reasons")


def checked_movement(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Movement rows and the damaged records beside them; a row needs its key."""
    return checked_csv(spark, path, MOVEMENT, ("store", "upc", "week"))


def read_movement(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, MOVEMENT)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, PRODUCTS)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; an empty one is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise SchemaError(f"{path} holds no rows")
    return df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, folder: str) -> str:
    """Appends rows below the folder, in a subfolder of their schema: a changed schema never mixes with older rows."""
    name = hashlib.sha256(json.dumps([f.jsonValue() for f in df.schema.fields], sort_keys=True).encode()).hexdigest()[:12]
    df.write.mode("append").parquet(f"{folder}/schema={name}")
    return f"{folder}/schema={name}"


_WIDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType())


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: the wider number, else text."""
    if a == b:
        return a
    order = {T.FloatType(): 4, **{t: i for i, t in enumerate(_WIDER)}}
    if a in order and b in order:
        return _WIDER[max(order[a], order[b])]
    return T.StringType()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of append_log of all schemas as one table: columns by name, in the order in which they first appear, null where a
    schema has none, of the type that holds all (else text); schema tells where a row is from. Schemas are few."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise SchemaError(f"no log at {folder}")
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("schema="))
    if not found:
        raise SchemaError(f"{folder} holds no log")
    parts = {name: spark.read.parquet(f"{folder}/{name}") for _, name in found}
    kinds: dict[str, T.DataType] = {}
    for df in parts.values():
        for f in df.schema.fields:
            kinds[f.name] = _common(kinds.get(f.name, f.dataType), f.dataType)
    out = None
    for name, df in parts.items():
        own = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()), F.lit(name.removeprefix("schema=")).alias("schema"))
        out = own if out is None else out.unionByName(own)
    return out


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(payload: dict, path: str, spark: SparkSession) -> None:
    """One document of metrics; numbers that are no numbers become null."""
    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        x = x.item() if hasattr(x, "item") else x
        return None if isinstance(x, float) and not math.isfinite(x) else x

    spark.createDataFrame([(json.dumps(plain(payload), default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """A document of write_json, or of any file with one JSON object: where a table comes from, or its metrics."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_sorted(df: DataFrame, path: str) -> None:
    """The panel in the order of product, store and week within each file, a range of products a file."""
    df.repartitionByRange("upc", "store").sortWithinPartitions("upc", "store", "week").write.mode("overwrite").parquet(path)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-insensitive content hash."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_hash"))


def movement_from_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly product by store movement from lineitem, part and supplier: the brand's number is the
    product, the supplier's nation the store."""
    read = lambda t: let_workers_import(spark).read.parquet(f"{folder}/{t}.parquet")
    sales = (
        read("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("day"))
        .join(read("part").select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("long").alias("upc")), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("store")), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    week = (F.floor(F.datediff("day", F.lit("1995-01-02").cast("date")) / 7) + 1).cast("long")
    totals = sales.groupBy("upc", "store", week.alias("week")).agg(
        F.sum("l_quantity").alias("move"), F.sum("l_extendedprice").alias("value"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    discount = F.round("discount", 6)
    return totals.select(
        "upc", "store", "week", "move", F.lit(1.0).alias("qty"), money(F.col("value") / F.col("move") / 1000).alias("price"),
        F.when(discount >= 0.08, "B").when(discount >= 0.06, "S").alias("sale"), F.round(25 - 100 * F.col("discount"), 6).alias("profit"),
        F.when(F.round("tax", 6) < 0.005, 0).otherwise(1).alias("ok"),
    )
