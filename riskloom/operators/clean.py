"""Projections that bring a frame into the shape a model or a report expects."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions.text import date_text


class MissingColumns(ValueError):
    """Required columns are not in the frame."""


def drop_control(df: DataFrame) -> DataFrame:
    return df.drop(*schema.CONTROL)


def require(df: DataFrame, needed: list[str] = schema.REQUIRED) -> DataFrame:
    """The frame itself, or an error that names what is missing; starts no job."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise MissingColumns("Columnas faltantes: " + ", ".join(missing))
    return df


def canonical_dates(df: DataFrame) -> DataFrame:
    present = [c for c in schema.DATE_COLUMNS if c in df.columns]
    return df.withColumns({c: date_text(F.col(c), schema.UNKNOWN) for c in present})


def align(df: DataFrame, model_columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Only the model's columns, in its order; absent ones get 0 or the unknown word."""
    clean = canonical_dates(require(df.drop(*[c for c in schema.CONTROL if c not in keep])))

    def neutral(name: str) -> Column:
        return F.lit(schema.UNKNOWN if name in schema.TEXT_FEATURES else 0).alias(name)

    return clean.select(*keep, *[F.col(c) if c in clean.columns else neutral(c)
                                 for c in model_columns])


def reindex(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of another frame: extra ones drop, absent ones become typed nulls."""
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def present(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns that exist, in the preferred order; all columns if none exists."""
    cols = [c for c in preferred if c in df.columns]
    return df.select(*cols) if cols else df


def null_nans(df: DataFrame) -> DataFrame:
    """NaN as null, so that comparisons on it are never true."""
    nans = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in nans}) if nans else df
