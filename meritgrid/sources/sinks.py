"""Output shapes and writers: ranked tables, audit rows, flattened status columns, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.text import filled


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def ranking_rows(ranked: DataFrame) -> DataFrame:
    """Summary columns of a ranked table; commas in names become semicolons."""
    return ranked.select(
        F.col("overall_rank").alias("rank"),
        F.replace(filled("name"), F.lit(","), F.lit(";")).alias("name"),
        filled("country").alias("country"),
        filled("region").alias("region"),
        filled("hospital_type").alias("hospital_type"),
        "total_score",
        two_decimals(F.col("percentile")).alias("percentile"),
        "certification_count",
    )


def save_rankings(ranked: DataFrame, folder: str) -> None:
    """Full table as JSON lines and the summary as CSV, both in rank order."""
    ranked.sort("overall_rank").write.mode("errorifexists").json(f"{folder}/complete")
    ranking_rows(ranked).sort("rank").write.mode("errorifexists").option("header", True).csv(f"{folder}/summary")


def audit_rows(orgs: DataFrame, certs: DataFrame, sources: DataFrame, flags: DataFrame) -> DataFrame:
    """One flat row per organisation: sources, certification count and names, registry flag, dates.

    ``sources(seq, pos, source)`` and ``flags(seq, has_jci, jci_accreditation_date,
    jci_expiry_date)``. Repeated certification names are listed once with their count.
    """
    names = certs.groupBy("seq", F.trim(filled("name")).alias("_name")).agg(F.min("pos").alias("_p"), F.count("*").alias("_n"))
    listed = names.groupBy("seq").agg(
        F.sum("_n").alias("certifications_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_name"))), lambda s: s["_name"]), "; ").alias("certification_names"),
    )
    firsts = sources.groupBy("seq", "source").agg(F.min("pos").alias("_p"))
    from_where = firsts.groupBy("seq").agg(
        F.count("*").alias("source_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "source"))), lambda s: s["source"]), "; ").alias("sources"),
    )
    joined = orgs.join(from_where, "seq", "left").join(listed, "seq", "left").join(flags, "seq", "left")
    return joined.select(
        F.col("seq").alias("id"),
        filled("name").alias("name"),
        filled("country").alias("country"),
        filled("city").alias("city"),
        filled("sources").alias("sources"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        F.coalesce("certifications_count", F.lit(0)).alias("certifications_count"),
        filled("certification_names").alias("certification_names"),
        F.when(F.col("has_jci") == 1, "yes").otherwise("no").alias("has_jci"),
        filled("jci_accreditation_date").alias("jci_accreditation_date"),
        filled("jci_expiry_date").alias("jci_expiry_date"),
        filled("website").alias("website"),
    )


def save_audit(rows: DataFrame, folder: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(folder)


def status_columns(orgs: DataFrame, by_body: str = "certifications", bodies: tuple[str, ...] = ("nabh", "jci")) -> DataFrame:
    """Map body -> struct(status, ...) replaced by one status column per body."""
    statuses = [F.try_element_at(by_body, F.lit(b))["status"].alias(f"{b}_status") for b in bodies]
    return orgs.select("*", *statuses).drop(by_body)


def save_snapshot(table: DataFrame, folder: str, as_of: str) -> str:
    """Write a table under its own snapshot folder; existing snapshots are never overwritten."""
    target = f"{folder}/snapshot={as_of}"
    table.write.mode("errorifexists").parquet(target)
    return target
