"""Panels in files: CSV, Parquet and NPZ archives; submissions; feature checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ordinal, split_date
from ..functions.measures import coerce
from ..operators.features import WEATHER
from .shared import files_at


def csv_schema(columns: Sequence[str]) -> T.StructType:
    """Everything as text: numbers are coerced later, so a bad cell is null and no error."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_panel_csv(spark: SparkSession, path: str, measures: Sequence[str] = WEATHER, score: bool = True, rows: int | None = None) -> DataFrame:
    """A daily panel with region_id, date and measures; adds year, month, day and ordinal. `rows` takes that many only."""
    names = spark.read.option("header", True).csv(path).columns
    missing = {"region_id", "date"} - set(names)
    if missing:
        raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
    raw = spark.read.option("header", True).schema(csv_schema(names)).csv(path)
    raw = raw if rows is None else raw.limit(rows)
    numbers = [c for c in (*measures, *(["score"] if score else [])) if c in names]
    parsed = raw.withColumn("_d", split_date(F.col("date")))
    return parsed.select(
        F.trim("region_id").alias("region_id"), F.col("date"), F.col("_d.year").alias("year"), F.col("_d.month").alias("month"), F.col("_d.day").alias("day"),
        ordinal(F.col("_d.year"), F.col("_d.month"), F.col("_d.day")).alias("ordinal"), *(coerce(F.col(c)).alias(c) for c in numbers),
    )


def read_panel_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_panel_parquet(df: DataFrame, path: str, append: bool = False) -> None:
    """Dictionary-encoded, compressed columns; commits as a whole."""
    df.write.mode("append" if append else "errorifexists").parquet(path)


#: Stands beside archives that were all written; a folder without it is half a panel.
WHOLE = "_SUCCESS"


def _whole(path: str) -> str:
    """`path`, if it is one archive or a folder whose archives are complete."""
    files, root = files_at(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if not root.endswith(".npz") and files.get_file_info(f"{root}/{WHOLE}").type.name != "File":
        raise FileNotFoundError(f"{path} has no {WHOLE}: its archives are not complete")
    return path


def _npz_rows(measures: Sequence[str], dates: Sequence[str] = ("year", "month", "day")):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for content in batch.column("content"):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as d:
                    code, n = d["region_id"], len(d["region_id"])
                    names = d["region_names"].astype(str)
                    cols = {c: d[c] for c in dates} | {c: d[c] if c in d else np.full(n, np.nan) for c in measures}
                for i in range(0, n, 65536):
                    part = {"region_id": pa.array(names[code[i : i + 65536]].tolist(), pa.string())}
                    part |= {c: pa.array(cols[c][i : i + 65536].astype(np.int32)) for c in dates}
                    part |= {c: pa.array(cols[c][i : i + 65536].astype(float), from_pandas=True) for c in measures}
                    yield pa.RecordBatch.from_pydict(part)

    return read


def _npz_writer(folder: str, measures: Sequence[str], dates: Sequence[str], rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyspark import TaskContext

        files, root = files_at(folder)
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        count = 0

        def save() -> pa.RecordBatch:
            nonlocal count
            whole = pa.Table.from_batches(held)
            names, code = np.unique(whole["region_id"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            content = io.BytesIO()
            columns = {c: whole[c].to_numpy().astype(np.int32) for c in dates} | {c: whole[c].to_numpy(zero_copy_only=False).astype(float) for c in measures}
            np.savez_compressed(content, region_id=code.astype(np.int32), region_names=names, **columns)
            name = f"part-{part:05d}-{count:05d}.npz"
            count += 1
            # a half-written archive has another name; a task that runs again puts equal rows in its place
            hidden = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(hidden) as out:
                out.write(content.getbuffer())
            files.move(hidden, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "rows": pa.array([len(code)], pa.int64())})

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                if n and n + piece.num_rows > rows:
                    yield save()
                    held.clear()
                    n = 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield save()

    return write


def write_panel_npz(df: DataFrame, path: str, measures: Sequence[str], rows: int = 1_000_000) -> int:
    """Write a panel, or a table of regions without dates, as compressed archives of at most `rows` rows; gives their number.

    `path` is a URI or an absolute folder that all executors share. Archives hold whole regions' rows in the order of days,
    as far as `rows` allows, with a dictionary of region names each; each appears under its name once it is complete.
    """
    dates = [c for c in ("year", "month", "day") if c in df.columns]
    picked = df.select(F.col("region_id").cast("string").alias("region_id"), *dates, *(F.col(c).cast("double").alias(c) for c in measures))
    sort = ["region_id", *dates, *measures]
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    make, root = files_at(uri)
    make.create_dir(root, recursive=True)
    done = picked.repartition("region_id").sortWithinPartitions(*sort).mapInArrow(_npz_writer(uri, measures, dates, rows), "archive string, rows long")
    archives = done.agg(F.coalesce(F.count("*"), F.lit(0))).first()[0]
    with make.open_output_stream(f"{root}/{WHOLE}") as mark:
        mark.write(str(archives).encode())
    return archives


def read_regions_npz(spark: SparkSession, path: str, measures: Sequence[str]) -> DataFrame:
    """Archives of regions without dates, as submission templates are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(_whole(path)).select("content")
    return files.mapInArrow(_npz_rows(measures, ()), "region_id string, " + ", ".join(f"{c} double" for c in measures))


def read_panel_npz(spark: SparkSession, path: str, measures: Sequence[str]) -> DataFrame:
    """Archives of columns with region codes and names, one task an archive; NaN becomes null.

    Names must be stored as fixed-width text: archives of pickled objects are refused.
    """
    schema = "region_id string, year int, month int, day int, " + ", ".join(f"{c} double" for c in measures)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(_whole(path)).select("content")
    rows = files.mapInArrow(_npz_rows(measures), schema)
    return rows.withColumn("ordinal", ordinal(F.col("year"), F.col("month"), F.col("day")))


def encode_regions(df: DataFrame) -> DataFrame:
    """Adds region_code, the rank of the region's name from 0: one row for each region is ranked."""
    from pyspark.sql import Window

    codes = df.select("region_id").distinct().select("region_id", (F.row_number().over(Window.orderBy("region_id")) - 1).cast("long").alias("region_code"))
    return df.join(codes, ["region_id"])


def find_panels(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of a pattern under a folder, at any depth."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)


def write_encoded(df: DataFrame, path: str) -> None:
    """A panel with region codes, as narrow dictionary-encoded columns; the folder is complete once _SUCCESS is there."""
    coded = encode_regions(df)
    narrow = [F.col(n).cast("float").alias(n) if k == "double" else F.col(n).cast("int").alias(n) if n in ("year", "month", "day") else F.col(n) for n, k in coded.dtypes]
    coded.select(*narrow).write.mode("errorifexists").parquet(path)


def write_submission(forecasts: DataFrame, template: DataFrame, path: str) -> None:
    """CSV parts that follow each other in the template's order (its column `place`)."""
    placed = forecasts.join(template.select("region_id", "place"), ["region_id"])
    placed.orderBy("place").drop("place").write.mode("overwrite").option("header", True).csv(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_atomic(df: DataFrame, path: str) -> None:
    """Parquet that replaces what is at `path`: written beside it, then the old is moved aside, the new one in, and the old deleted.

    A stop between the moves leaves both whole: :func:`restore` brings the old one back.
    """
    import uuid

    spark = df.sparkSession
    hidden = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(hidden)
    new, to, aside = (_path(spark, p) for p in (hidden, path, path.rstrip("/") + ASIDE))
    files = restore(spark, path)
    if files.exists(to) and not files.rename(to, aside):
        raise OSError(f"{path} could not be moved aside")
    if not files.rename(new, to):
        files.rename(aside, to)
        raise OSError(f"{hidden} could not be renamed to {path}")
    files.delete(aside, True)


#: Where the old content waits while the new one is moved in.
ASIDE = ".old"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def restore(spark: SparkSession, path: str):
    """Undoes or ends a replacement that stopped half-way; gives the file system."""
    to, aside = _path(spark, path), _path(spark, path.rstrip("/") + ASIDE)
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(aside):
        if files.exists(to):
            files.delete(aside, True)
        else:
            files.rename(aside, to)
    return files


def load_or_compute(spark: SparkSession, root: str, names: Sequence[str], compute) -> DataFrame:
    """A checkpoint whose path holds a hash of the feature names, so other features make another checkpoint."""
    path = f"{root.rstrip('/')}/{hashlib.sha256('|'.join(names).encode()).hexdigest()[:16]}"
    if not restore(spark, path).exists(_path(spark, f"{path}/_SUCCESS")):
        write_atomic(compute(), path)
    return spark.read.parquet(path)


def synthetic_panel(spark: SparkSession, regions: int, days: int, seed: int = 42, measures: Sequence[str] = WEATHER) -> DataFrame:
    """Uniform random measures and scores."""
    ids = spark.range(regions * days).select((F.floor(F.col("id") / days) + 1).alias("r"), (F.col("id") % days).cast("int").alias("d"))
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))
    named = ids.select(F.concat(F.lit("R"), "r").alias("region_id"), F.year(date).alias("year"), F.month(date).alias("month"), F.day(date).alias("day"))
    values = [(F.rand(seed + i) * 100).alias(c) for i, c in enumerate(measures)]
    return named.select("*", ordinal(F.col("year"), F.col("month"), F.col("day")).alias("ordinal"), *values, (F.rand(seed - 1) * 5).alias("score"))
