"""Reading analysis inputs.

Inputs are long tables keyed by atom name:

* calls  ``(src STRING, dst STRING, w DOUBLE)``;
* terms  ``(atom STRING, term STRING, x DOUBLE)``;
* names  ``(atom STRING[, idx BIGINT])`` -- the analysis' support.

Folder convention (S9): ``{base}/{analysis}/{granularity}_{calls|tfidf|names}``
holding parquet.  A wide matrix table (one column per atom, S7) is unpivoted to
the long form; a ``.npy`` matrix (S8) is read in row blocks by the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

FORMATS = ("parquet", "csv", "json")
ANALYSIS_KINDS = ("dynamic", "structural", "semantic", "sum")
GRANULARITIES = ("class", "method")
# Folder and file-name convention; fixed values.
FILE_NAMES = {"calls": "{}_calls", "tfidf": "{}_tfidf", "names": "{}_names"}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet / csv (header) / json; anything else is rejected."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format {fmt!r}; expected one of {FORMATS}")
    r = spark.read
    if schema:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("inferSchema", schema is None).csv(path)
    return getattr(r, fmt)(path)


def unpivot_matrix(df: DataFrame, id_col: str, kind: str = "calls") -> DataFrame:
    """Wide matrix (row key column + one numeric column per atom) -> long rows.

    ``calls``: ``(src=row key, dst=column name, w)``; ``terms``: ``(atom, term=column, x)``.
    Zero cells are dropped.
    """
    value_cols = [c for c in df.columns if c != id_col]
    casted = df.select(F.col(id_col).cast("string").alias(id_col), *[F.col(f"`{c}`").cast("double").alias(c) for c in value_cols])
    if kind == "calls":
        long = casted.unpivot([id_col], value_cols, "dst", "w").withColumnRenamed(id_col, "src")
        return long.where(F.col("w") != 0).select("src", "dst", "w")
    if kind == "terms":
        long = casted.unpivot([id_col], value_cols, "term", "x").withColumnRenamed(id_col, "atom")
        return long.where(F.col("x") != 0).select("atom", "term", "x")
    raise ValueError(f"Unknown matrix kind {kind!r}")


def analysis_path(base: str, analysis: str, granularity: str, what: str) -> str:
    """S9 path convention."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    return "/".join([base.rstrip("/"), analysis, FILE_NAMES[what].format(granularity)])


def _read_or_none(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The table, or None where Spark's file system has no such path (any scheme)."""
    try:
        return read_table(spark, path, fmt)
    except AnalysisException as ex:
        if ex.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_inputs(
    spark: SparkSession,
    analysis: str,
    granularity: str = "class",
    features_path: str | None = None,
    names_path: str | None = None,
    base_path: str | None = None,
    derive: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
    fmt: str = "parquet",
) -> tuple[DataFrame, DataFrame]:
    """``(features, names)`` from explicit paths, else the folder convention,
    else ``derive()`` (R1-R5 computed by the caller); otherwise ``ValueError``."""
    if analysis not in ("dynamic", "structural", "semantic"):
        raise ValueError(f"{analysis!r} has no input tables")
    what = "tfidf" if analysis == "semantic" else "calls"
    if features_path and names_path:
        return read_table(spark, features_path, fmt), read_table(spark, names_path, fmt)
    if base_path:
        features = _read_or_none(spark, analysis_path(base_path, analysis, granularity, what), fmt)
        names = _read_or_none(spark, analysis_path(base_path, analysis, granularity, "names"), fmt)
        if features is not None and names is not None:
            return features, names
    if derive is not None:
        return derive()
    raise ValueError(f"neither the paths nor {base_path!r} hold tables for the {analysis} analysis")


def save_inputs(features: DataFrame, names: DataFrame, base: str, analysis: str, granularity: str = "class") -> str:
    """Store an analysis' features and names under the folder convention."""
    if analysis not in ("dynamic", "structural", "semantic"):
        raise ValueError(f"{analysis!r} has no input tables")
    what = "tfidf" if analysis == "semantic" else "calls"
    features.write.mode("overwrite").parquet(analysis_path(base, analysis, granularity, what))
    names.write.mode("overwrite").parquet(analysis_path(base, analysis, granularity, "names"))
    return f"{base.rstrip('/')}/{analysis}"


def edges_from_npy(spark: SparkSession, npy_path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """A dense ``.npy`` matrix on a shared path -> ``(src_pos, dst_pos, w)`` non-zeros.

    The driver reads only the header (shape); a task memory-maps the file and scans blocks of
    at most ``block_bytes`` as doubles: some rows, or a slice of the columns of one long row.
    The file must be on a path that driver and executors mount alike (``file:`` is taken off).
    """
    import numpy as np

    local = npy_path.removeprefix("file://").removeprefix("file:")
    n_rows, n_cols = (int(x) for x in np.load(local, mmap_mode="r").shape)
    cells = max(1, block_bytes // 8)
    rows = max(1, cells // max(1, n_cols))
    starts = spark.range(0, n_rows, rows, numPartitions=max(1, -(-n_rows // rows)))
    schema = T.StructType(
        [T.StructField("src_pos", T.LongType()), T.StructField("dst_pos", T.LongType()), T.StructField("w", T.DoubleType())]
    )

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        m = np.load(local, mmap_mode="r")
        for b in batches:
            for s in b.column(0).to_pylist():
                for at in range(0, n_cols, cells):
                    block = np.asarray(m[s : s + rows, at : at + cells], dtype="float64")
                    r, c = np.nonzero(block)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.astype("int64") + s), pa.array(c.astype("int64") + at), pa.array(block[r, c])],
                        schema=pa.schema([("src_pos", pa.int64()), ("dst_pos", pa.int64()), ("w", pa.float64())]),
                    )

    return starts.mapInArrow(scan, schema)


def positions_to_names(edges_pos: DataFrame, names: DataFrame) -> DataFrame:
    """Map matrix positions to names ``(atom, idx=position)`` -> ``(src, dst, w)``."""
    n = names.select("atom", "idx")
    return (
        edges_pos.join(n.select(F.col("idx").alias("src_pos"), F.col("atom").alias("src")), "src_pos")
        .join(n.select(F.col("idx").alias("dst_pos"), F.col("atom").alias("dst")), "dst_pos")
        .select("src", "dst", "w")
    )
