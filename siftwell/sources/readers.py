"""Datasets by name: files, a packaged demo, or pre-downloaded hub folders."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

LAZY, EAGER = (".csv", ".jsonl", ".ndjson", ".parquet"), (".json", ".xlsx")
DEMO = [
    ("demo-1", "Tides follow the moon. Twice a day the sea rises and falls.", ["why does the sea rise"], "Explain", [("tides", "rise and fall of the sea")]),
    ("demo-2", "Rye bread keeps longer than wheat bread because it is more sour.", ["which bread keeps longest"], "Explain", [("rye", "a grain")]),
    ("demo-3", "A glacier is old snow that has turned to ice and flows downhill.", ["what is a glacier", "does ice flow"], "Explain", [("glacier", "flowing ice")]),
]
DEMO_SCHEMA = "chunk_id string, content string, queries array<string>, instruction string, keywords array<struct<keyword_or_phrase:string,explanation:string>>"


class DatasetError(ValueError):
    pass


def resolve(source: str) -> tuple[str, str]:
    """``(kind, where)``, in this order: existing file, demo, refused schemes, hub name, not found."""
    path = Path(source).expanduser()
    if path.is_file() or (path.suffix == ".parquet" and path.is_dir()):
        return "file", str(path)
    if source == "demo":
        return "demo", source
    if re.match(r"https?://|builtin://|hf://", source) or "://" in source or "?" in source:
        raise DatasetError(f"unsupported source {source!r}: give a file, 'demo' or owner/name")
    if re.fullmatch(r"[\w.-]+/[\w.-]+", source):
        return "hub", source
    raise DatasetError(f"dataset {source!r} not found")


def check_lazy(path: str, lazy: bool) -> str:
    """The file's suffix, if it can be read that way."""
    suffix = Path(path).suffix.lower()
    if suffix not in LAZY + EAGER:
        raise DatasetError(f"unsupported format {suffix!r}; known: {', '.join(LAZY + EAGER)}")
    if lazy and suffix in EAGER:
        raise DatasetError(f"{suffix} can't be read lazily; lazy formats: {', '.join(LAZY)}")
    return suffix


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A list of rows, an object with a list ``data``, or one row."""
    df = spark.read.option("multiLine", True).json(path)
    kind = df.schema["data"].dataType if "data" in df.columns else None
    if len(df.columns) == 1 and isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return df.select(F.explode("data").alias("row")).where("row is not null").select("row.*")
    return df


def _xlsx(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise DatasetError("reading .xlsx needs the package openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def hub_files(files: list[str], split: str | None, config: str | None) -> list[str]:
    """Parquet files of a split and configuration by their path's parts, sorted."""
    out = []
    for f in sorted(files):
        parts = Path(f).parts
        stem = Path(f).stem
        if not f.endswith(".parquet") or (config and config not in parts[:-1]):
            continue
        if split and not (split in parts[:-1] or stem == split or stem.startswith((f"{split}-", f"{split}_"))):
            continue
        out.append(f)
    return out


def _hub(spark: SparkSession, name: str, split: str | None, config: str | None, root: str | None) -> DataFrame:
    """A pre-downloaded folder ``root/owner/name``; splits ``a|b`` are tried in order."""
    base = Path(root or "") / name
    files = [str(p.relative_to(base)) for p in base.rglob("*.parquet")] if root else []
    for s in (split or "").split("|"):
        chosen = hub_files(files, s or None, config)
        if chosen:
            return spark.read.parquet(*(str(base / f) for f in chosen))
    raise DatasetError(f"no parquet files for {name!r}, split {split!r}, below {root!r}")


def read_dataset(
    spark: SparkSession, source: str, *, lazy: bool = True, split: str | None = None, config: str | None = None,
    limit: int | None = None, drop_columns: list[str] | None = None, hub_root: str | None = None,
) -> DataFrame:
    """Read a dataset; columns are dropped first (unknown names are no error), then rows limited."""
    if not isinstance(lazy, bool):
        raise TypeError("lazy must be a bool")
    if limit is not None and (isinstance(limit, bool) or limit < 0):
        raise ValueError("limit must be at least 0")
    kind, where = resolve(source)
    if kind != "hub" and (split or config):
        raise DatasetError("split and config are for hub datasets only")
    if kind == "demo":
        df = spark.createDataFrame(DEMO, DEMO_SCHEMA)
    elif kind == "hub":
        df = _hub(spark, where, split, config, hub_root)
    else:
        suffix = check_lazy(where, lazy)
        if suffix == ".csv":
            df = spark.read.csv(where, header=True, inferSchema=True, multiLine=True, escape='"')
        elif suffix in (".jsonl", ".ndjson"):
            df = spark.read.json(where)
        elif suffix == ".parquet":
            df = spark.read.parquet(where)
        elif suffix == ".json":
            df = _json_rows(spark, where)
        else:
            df = _xlsx(spark, where)
    df = df.drop(*(c for c in drop_columns or [] if c.strip()))
    return df if limit is None else df.limit(limit)


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Pieces of a text file between separators; empty ones are dropped."""
    return spark.read.text(path, lineSep=separator).where("trim(value) <> ''")
