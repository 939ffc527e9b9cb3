"""Atlas tables, colour tables, participant lists and result bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import aliased, pairs, without_terms
from .volumes import listing


def read_atlas(spark: SparkSession, path: str, ignore: list[str] | None = None, strict: bool = True) -> DataFrame:
    """(idx, name, color) of a tab-separated atlas table. Rows of other widths fail the job, or are dropped if not ``strict``."""
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("cells", cells)
    wrong = F.size("cells") != 3
    if strict:
        lines = lines.withColumn("cells", F.when(wrong, F.raise_error(F.concat(F.lit("not three columns: "), F.col("value"))).cast("array<string>")).otherwise(F.col("cells")))
    else:
        lines = lines.where(~wrong)
    # The header is the one line whose id isn't a number.
    raw = lines.select(F.col("cells")[0].try_cast("int").alias("idx"), F.trim(F.col("cells")[1]).alias("name"), F.trim(F.col("cells")[2]).alias("color")).where("idx is not null")
    return raw.where(without_terms(F.col("name"), ignore or []))


def parcel_header(atlas: DataFrame, cutoff: int = 3000) -> DataFrame:
    """(parcel_id, label, color): ids under ``cutoff`` with the parts of their names, and id 0 for the background."""
    rows = atlas.where(F.col("idx") < cutoff).select(F.col("idx").alias("parcel_id"), F.split("name", "-").alias("label"), "color")
    background = atlas.sparkSession.range(1).select(F.lit(0).alias("parcel_id"), F.array(F.lit("BND")).alias("label"), F.lit("#000000").alias("color"))
    return rows.unionByName(background)


def read_atlas_xml(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(idx, name) of an XML atlas: the index and text of its label elements."""
    raw = spark.read.format("xml").option("rowTag", "label").schema("_index int, _VALUE string").load(path)
    return raw.select(F.col("_index").alias("idx"), F.concat(F.lit(prefix), F.col("_VALUE")).alias("name"))


def read_colour_map(spark: SparkSession, path: str) -> DataFrame:
    """(n, r, g, b) lines of three numbers, in order; an error unless there are 256."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    lines = spark.read.text(path).coalesce(1).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("n"), *(parts[k].cast("double").alias(c) for k, c in enumerate("rgb")))
    if (count := lines.count()) != 256:
        raise ValueError(f"a colour map has 256 lines, not {count}")
    return lines


def read_participants(spark: SparkSession, path: str, distinct: bool = True, drop_sessions: tuple[str, ...] = ("V2BIS",)) -> DataFrame:
    """(subject, session, ord) of a participant list, tabs for .tsv, else commas; headers by any usual name.

    The lists are driver-sized, so the order of their lines is taken from one partition.
    """
    sep = "\t" if path.endswith(".tsv") else ","
    raw = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    named = aliased(raw, {"subject": ["participant_id", "participant", "subject_id", "sub", "id"], "session": ["session_id", "ses", "visit"]})
    rows = named.coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    found = pairs(rows, "subject", "session", "ord") if distinct else rows
    return without_sessions(found, drop_sessions)


def without_sessions(rows: DataFrame, dropped: tuple[str, ...] = ("V2BIS",)) -> DataFrame:
    """``rows`` without those sessions; rows without a session stay."""
    for session in dropped:
        rows = rows.where(~F.col("session").eqNullSafe(session))
    return rows


def recordings_to_process(spark: SparkSession, path: str, participants: str | None = None) -> DataFrame:
    """(subject, session) in order: those of a participant list, if one is given, else the folders sub-*/ses-* under ``path``."""
    found = read_participants(spark, participants).orderBy("ord") if participants else discover_recordings(spark, path).orderBy("subject", "session")
    return found.select("subject", "session")


def recordings_with(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """(subject, session, files) of the recordings whose folder of a modality holds files, by subject."""
    files = listing(spark, path).select(F.regexp_extract("path", "/sub-([^/]+)/ses-([^/]+)/([^/]+)/", 1).alias("subject"), F.regexp_extract("path", "/sub-([^/]+)/ses-([^/]+)/([^/]+)/", 2).alias("session"), F.regexp_extract("path", "/sub-([^/]+)/ses-([^/]+)/([^/]+)/", 3).alias("modality"))
    return files.where(F.col("modality") == modality).groupBy("subject", "session").agg(F.count("*").alias("files")).orderBy("subject", "session")


def discover_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(subject, session, files) from folders sub-*/ses-* under ``path``."""
    files = listing(spark, path).select(F.regexp_extract("path", "/sub-([^/]+)/", 1).alias("subject"), F.regexp_extract("path", "/ses-([^/]+)/", 1).alias("session"))
    return files.where("subject <> '' and session <> ''").groupBy("subject", "session").agg(F.count("*").alias("files"))


def write_atlas(atlas: DataFrame, path: str) -> None:
    from .volumes import color_of

    atlas.select("idx", "name", color_of(F.col("idx")).alias("color")).write.option("sep", "\t").option("header", True).csv(path)


def write_bundle(members: dict[str, DataFrame], path: str) -> None:
    """One Parquet dataset a member."""
    for name, df in members.items():
        df.write.parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_matrix_text(matrix: DataFrame, path: str, row: str = "i", col: str = "j", value: str = "w", digits: int = 6) -> None:
    """A matrix as text lines, a row each, in order of the labels. A row holds as many values as there are parcels."""
    cell = F.struct(F.col(col).alias("c"), F.format_string(f"%.{digits}f", F.col(value)).alias("v"))
    lines = matrix.groupBy(row).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    lines.orderBy(row).select(F.array_join(F.transform("cells", lambda x: x["v"]), " ").alias("value")).coalesce(1).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_statistic_inputs(stack: DataFrame, places: DataFrame, design: DataFrame, path: str, by: str = "subject") -> None:
    """The text inputs of a network statistic: a matrix a recording, node coordinates, node labels and the design, each a folder of text."""
    for r in stack.select(by).distinct().orderBy(by).collect():  # one row a recording
        write_matrix_text(stack.where(F.col(by) == r[0]), f"{path}/matrices/{r[0]}")
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    places.orderBy("node").select(F.concat_ws(" ", *(number(c) for c in "xyz")).alias("value")).coalesce(1).write.text(f"{path}/coordinates")
    places.orderBy("node").select(F.col("name").alias("value")).coalesce(1).write.text(f"{path}/labels")
    columns = [c for c in design.columns if c != by]
    design.orderBy(by).select(F.concat_ws(" ", *(number(c) for c in columns)).alias("value")).coalesce(1).write.text(f"{path}/design")
