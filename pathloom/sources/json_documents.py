"""JSON in and out with declared schemas: broken records are counted, sets are sorted, empty cells are empty texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BROKEN = "_broken"


class BrokenRecords(ValueError):
    """Records of a JSON file that don't follow the declared schema."""


def _refuse_broken(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` without the column of broken records; an error, with an example, if there are any."""
    kept = [c for c in rows.columns if c != BROKEN]
    # A column beside the broken records: Spark does not read them alone.
    n, example, _ = rows.agg(F.count(BROKEN), F.min(BROKEN), F.count(f"`{kept[0]}`")).first()
    if n:
        raise BrokenRecords(f"{n} broken records in {path}, such as {example[:200]!r}")
    return rows.select(*[F.col(f"`{c}`") for c in kept])


def read_json(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = False) -> DataFrame:
    """Documents of a declared schema, a line each (``multi_line``: a file is an array of documents, or one); a broken one is an error."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    told = StructType([*declared.fields]).add(BROKEN, "string")
    return _refuse_broken(spark.read.schema(told).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("multiLine", multi_line).json(path), path)


def read_keyed(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """Files that are one object each, ``{"7": {...}, "8": {...}}``, as rows: the key and the value's fields, parsed by a declared schema.

    A file is one cell: such files are curated lists and caches of thousands of records.
    """
    texts = spark.read.option("wholetext", True).text(path)
    parsed = texts.select("value", F.from_json("value", f"map<string, {value}>", {"mode": "PERMISSIVE"}).alias("held"))
    checked = _refuse_broken(parsed.select("held", F.when(F.col("held").isNull() & (F.trim("value") != ""), F.col("value")).alias(BROKEN)), path)
    return checked.select(F.explode("held").alias(key, "v")).select(key, "v.*")


def json_cell(column: Column, kind: str) -> Column:
    """A value as the text of a table's cell: nothing for null and for what is empty; lists, maps and structures as JSON."""
    if kind.startswith(("array", "map")):
        return F.when(F.size(column) > 0, F.to_json(column)).otherwise("")
    return F.coalesce(F.to_json(column) if kind.startswith("struct") else column.cast("string"), F.lit(""))


def write_json(df: DataFrame, path: str, sets: list[str] | None = None) -> None:
    """A document a line; the arrays named in ``sets`` have no order of their own and are written sorted."""
    rows = df.withColumns({name: F.array_sort(name) for name in sets}) if sets else df
    rows.write.mode("overwrite").json(path)


def search_document(hits: DataFrame, search: str, date: str, co_occurrence_only: bool = False) -> DataFrame:
    """Result rows as documents, each with the search's name, date and number of results."""
    counted = hits.agg(F.count("*").alias("total_results"), F.count_if("has_priority_term_match").alias("priority_results"))  # one row
    told = F.struct(F.lit(search).alias("config"), F.lit(date).alias("search_date"), F.lit(co_occurrence_only).alias("co_occurrence_only"), F.struct("total_results", "priority_results").alias("summary"))
    return hits.select(F.struct("*").alias("result")).crossJoin(counted).select(told.alias("search"), "result")
