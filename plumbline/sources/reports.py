"""Report outputs: handover bundles with a hashed manifest, HTML tables, DXF text and heat-map SVG, all written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import ranked

# Fill colours of deviation buckets.
FILLS = {"lt5": "#2e7d32", "5_15": "#f9a825", "15_50": "#ef6c00", "ge50": "#c62828", "unknown": "#9e9e9e"}


def bundle(sections: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each section as JSON lines under its name and returns the manifest, written last: section, file, bytes, sha256.

    A bundle without a manifest is not complete. Files are hashed by Spark where they lie.
    """
    if not sections:
        raise ValueError("a bundle has a section at least")
    spark = next(iter(sections.values())).sparkSession
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    files = spark.read.format("binaryFile").load([f"{path}/{name}/part-*" for name in sections])
    part = F.split("path", "/")
    rows = files.select(F.element_at(part, -2).alias("section"), F.element_at(part, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(rows.schema).parquet(f"{path}/manifest")


def changed(spark: SparkSession, path: str) -> DataFrame:
    """Files of a bundle whose content isn't that of the manifest, or that are missing or new."""
    manifest = spark.read.parquet(f"{path}/manifest")
    names = [r[0] for r in manifest.select("section").distinct().collect()]
    files = spark.read.format("binaryFile").load([f"{path}/{n}/part-*" for n in names])
    part = F.split("path", "/")
    now = files.select(F.element_at(part, -2).alias("section"), F.element_at(part, -1).alias("file"), F.sha2("content", 256).alias("now"))
    return manifest.join(now, ["section", "file"], "full").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("section", "file")


def escaped(c: Column) -> Column:
    c = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def html_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """n, line: a table's head and rows as HTML, numbered in the order of the key."""
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in df.columns], F.lit("</tr>"))
    rows = ranked(df.withColumn("line", cells).select(*key, "line"), [*key, "line"], "n").select("n", "line")
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    return df.sparkSession.createDataFrame([(0, head)], "n long, line string").unionByName(rows)


def dxf_lines(lines: DataFrame, layer: str = "WALLS") -> DataFrame:
    """One LINE entity as text for each row with x0, y0, x1, y1 (metres)."""
    text = "0\nLINE\n8\n" + layer + "\n10\n%.4f\n20\n%.4f\n11\n%.4f\n21\n%.4f"
    return lines.select(F.format_string(text, "x0", "y0", "x1", "y1").alias("entity"))


def heatmap_shapes(deviations: DataFrame, scale: float = 0.02) -> DataFrame:
    """A dot for each row with cx, cy and distance_mm, filled by its bucket."""
    d = F.col("distance_mm")
    fill = F.when(d.isNull(), FILLS["unknown"]).when(d < 5, FILLS["lt5"]).when(d < 15, FILLS["5_15"]).when(d < 50, FILLS["15_50"]).otherwise(FILLS["ge50"])
    return deviations.select(F.format_string('<circle cx="%.2f" cy="%.2f" r="3" fill="%s"/>', F.col("cx") * scale, F.col("cy") * scale, fill).alias("shape"))


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """entity, ifc_class, global_id, name of the named entities of an exchange text; one line for each entity is assumed, as files are written."""
    line = F.col("value")
    rows = spark.read.text(path).select(
        F.regexp_extract(line, r"^#(\d+)\s*=", 1).alias("entity"),
        F.regexp_extract(line, r"=\s*IFC([A-Z0-9]+)\s*\(", 1).alias("ifc_class"),
        F.regexp_extract(line, r"\(\s*'([^']*)'", 1).alias("global_id"),
        F.regexp_extract(line, r"^[^']*'[^']*'\s*,\s*[^,]*,\s*'([^']*)'", 1).alias("name"),
    )
    return rows.filter((F.col("ifc_class") != "") & (F.col("global_id") != "")).withColumn("entity", F.col("entity").cast("long"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """point_id, label of .npy files of one integer for each point; a row's place is its id. A file is read by one task."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                labels = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1).astype(np.int64)
                for at in range(0, len(labels), 1 << 16):
                    part = labels[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["point_id", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "point_id long, label long")
