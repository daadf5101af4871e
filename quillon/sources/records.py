"""Record files: prompts, preference pairs, JSON lines, generations, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def scan(spark: SparkSession, paths: list[str], columns: list[str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Rows of Parquet and JSON-lines files, by suffix; any other suffix is an error.

    ``columns`` that a file lacks are null.
    """
    out = None
    for path in paths:
        if path.rstrip("/").endswith(".parquet"):
            df = spark.read.parquet(path)
        elif path.endswith((".json", ".jsonl")):
            df = (spark.read if schema is None else spark.read.schema(schema)).json(path)
        else:
            raise ValueError(f"neither Parquet nor JSON lines: {path}")
        if columns is not None:
            df = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def within_length(df: DataFrame, length, most: int) -> DataFrame:
    """Rows whose length expression is at most ``most``; a length that cannot be told is too long."""
    return df.filter(F.coalesce(length, F.lit(most + 1)) <= most)


def jsonl_views(spark: SparkSession, directory: str, schemas: dict[str, StructType | str]) -> list[str]:
    """A view for each ``{directory}/{name}.jsonl``; nested values become JSON text."""
    for name, schema in schemas.items():
        texts_of_nested(spark.read.schema(schema).json(f"{directory}/{name}.jsonl")).createOrReplaceTempView(name)
    return list(schemas)


def texts_of_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, other columns as they are."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def table_of(spark: SparkSession, name: str, samples: list[dict]) -> DataFrame:
    """A view of rows whose types the first row tells: whole numbers stay, text stays, the rest is JSON text."""
    import json

    first = samples[0]
    fields = ", ".join(f"`{k}` {'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'string'}" for k, v in first.items())
    rows = [tuple(v if v is None or isinstance(v, (int, str)) and not isinstance(v, bool) else json.dumps(v) for v in (s.get(k) for k in first)) for s in samples]
    df = spark.createDataFrame(rows, fields)
    df.createOrReplaceTempView(name)
    return df


def write_generations(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines by step."""
    df.write.partitionBy(step).mode("append").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One ``{step, data}`` line a step, ``data`` a map of metric names to values."""
    lines = df.groupBy("step").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("data"))
    lines.write.mode("overwrite").json(path)


def csv_line(*columns) -> object:
    """One RFC-4180 line: quotes only where needed, null as empty, nested as JSON."""
    def field(c):
        text = F.coalesce(c.cast(StringType()), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.regexp_like(text, F.lit('[",\\r\\n]')), quoted).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with CRLF line ends, a header in each."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)
