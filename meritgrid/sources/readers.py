"""Readers for organisation documents of varying shape and for folders of mixed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgrid.functions.exprs import col
from meritgrid.schemas import ORG, ORG_FIELDS

RECORD = "map<string,string>"


def organisation_items(document: Column | str, item: str = ORG) -> Column:
    """Items of a JSON document that is a list, an object with ``organizations``, or one object."""
    text = F.trim(col(document))
    as_list = F.from_json(text, f"array<{item}>")
    wrapped = F.from_json(F.get_json_object(text, "$.organizations"), f"array<{item}>")
    single = F.array(F.from_json(text, item))
    return F.when(F.startswith(text, F.lit("[")), as_list).otherwise(F.coalesce(wrapped, single))


def is_readable(document: Column | str) -> Column:
    return F.try_parse_json(col(document)).isNotNull()


def parse_documents(documents: DataFrame, column: str, item: str = ORG) -> DataFrame:
    """One row per organisation of every readable document; other columns are repeated."""
    keep = [c for c in documents.columns if c != column]
    return documents.filter(is_readable(column)).select(*keep, F.inline(organisation_items(column, item)))


def recover_documents(documents: DataFrame, column: str) -> DataFrame:
    """Name, website and address found by pattern in documents that are no valid JSON."""
    text = F.col(column)
    keep = [c for c in documents.columns if c != column]
    found = documents.filter(text.isNotNull() & ~is_readable(column)).select(
        *keep,
        *[F.regexp_extract(text, rf'"{f}"\s*:\s*"([^"]+)"', 1).alias(f) for f in ("name", "website", "address")],
    )
    return found.filter((F.col("website") != "") | (F.col("address") != ""))


def payload_items(payload: Column | str) -> Column:
    """Records of a search payload: a list, a list under results/data/organizations, or one object."""
    text = F.trim(col(payload))
    many = f"array<{RECORD}>"
    under = [
        F.from_json(F.nullif(F.get_json_object(text, f"$.{k}"), F.lit("")), many) for k in ("results", "data", "organizations")
    ]
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, many)).otherwise(
        F.coalesce(*under, F.array(F.from_json(text, RECORD)))
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents with their file name."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select("*", F.col("_metadata.file_name").alias("source_name")).withColumnRenamed("value", "document")


def read_organisations(spark: SparkSession, path: str) -> DataFrame:
    """Organisations of all documents under a path, broken documents recovered by pattern."""
    documents = read_documents(spark, path)
    parsed = parse_documents(documents, "document")
    return parsed.unionByName(recover_documents(documents, "document"), allowMissingColumns=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Organisations stored one per line, the form large tables are kept in."""
    return spark.read.schema(ORG_FIELDS).json(path)


def _csv_cells(line: str, width: int) -> Column:
    """Cells of a CSV line, as many as the line has; empty ones are null."""
    schema = ",".join(f"_{i} string" for i in range(width))
    cells = F.from_csv(line, F.lit(schema))
    return F.array(*[cells[f"_{i}"] for i in range(width)])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of CSV files as ``source_name, record``, each file by its own first line.

    Of equal header names the last cell stays, cells without a header name are dropped, missing
    cells are null and lines equal to the header are left out. Records do not span lines.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_name").alias("source_name"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"),
        F.regexp_replace("value", "^\ufeff", "").alias("_line"),
    )
    headers = lines.groupBy("_file").agg(F.min_by("_line", "_at").alias("_header"))
    width = headers.agg(F.max(F.size(F.split("_header", ",", -1)))).first()[0] or 1  # a schema has a fixed width
    joined = lines.join(headers, "_file").filter("_line <> _header")
    names, cells = F.col("_names"), F.col("_cells")
    split = joined.select("source_name", _csv_cells("_header", width).alias("_names"), _csv_cells("_line", width).alias("_cells"))
    last = F.filter(
        F.sequence(F.lit(1), F.size(names)),
        lambda i: F.element_at(names, i).isNotNull() & (F.array_position(F.slice(F.reverse(names), 1, F.size(names) - i), F.element_at(names, i)) == 0),
    )
    entries = F.transform(last, lambda i: F.struct(F.element_at(names, i), F.element_at(cells, i)))
    return split.select("source_name", F.map_from_entries(entries).alias("record"))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """JSON documents and CSV files of a folder as flat records tagged with their file name."""
    documents = read_documents(spark, f"{folder}/*.json")
    items = documents.filter(is_readable("document")).select("source_name", F.explode(payload_items("document")).alias("record"))
    return items.unionByName(csv_records(spark, f"{folder}/*.csv"))


def first_available(*sources: DataFrame) -> DataFrame:
    """The first source that has rows; later ones only serve when all before are empty."""
    out = sources[0]
    for later in sources[1:]:
        filled = out.limit(1).agg(F.count("*")).scalar() > 0
        out = out.unionByName(later.filter(~filled), allowMissingColumns=True)
    return out


def union_sources(named: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union of sources with differing columns, with priority and source columns."""
    out = None
    for priority, (name, df) in enumerate(named):
        tagged = df.withColumn("source_priority", F.lit(priority)).withColumn("source_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
