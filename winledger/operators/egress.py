"""The egress guard: find values that look like content before a table leaves the tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes and keys of metadata.
MAX_LABEL = 60
MAX_SIGNAL = 64
MAX_ID = 40
MAX_ID_SEGMENTS = 7
MAX_TEXT = 256
LABEL_KEYS = ("label", "cluster_label", "note", "signal", "verifier_spec")
SIGNAL_KEYS = ("signal", "verifier_spec")
ID_KEYS = ("model_id", "from_model", "to_model", "provider", "model_version_hint")
SAFE = r"^(sha256:[0-9a-f]{64}\n?\z|(trace|template)://)"


class ContentLeak(RuntimeError):
    """A table about to leave the tenant looks like it carries content."""


def _is_prose(v: Column) -> Column:
    words = F.size(F.filter(F.split(v, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    spaces = F.length(v) - F.length(F.replace(v, F.lit(" ")))
    return (words > 8) & (spaces > 6)


def _judge(value: Column, key: Column, path: Column) -> Column:
    """An array with the finding of one string, or none."""
    size = F.length(value)
    labelled = key.isin(*LABEL_KEYS)
    cap = F.when(key.isin(*SIGNAL_KEYS), MAX_SIGNAL).otherwise(MAX_LABEL)
    bare = F.trim(value)
    segments = F.size(F.split(bare, r"[-_./: ]+"))
    odd_id = (size > MAX_ID) | (segments > MAX_ID_SEGMENTS) | F.contains(bare, F.lit(" "))
    finding = (
        F.when(value.rlike(SAFE), None)
        .when(labelled, F.when((size > cap) | _is_prose(value), F.concat(
            path, F.lit(": "), key, F.lit(" exceeds label size ("), size.cast("string"), F.lit(" chars)"))))
        .when(key.isin(*ID_KEYS), F.when(odd_id, F.concat(
            path, F.lit(": "), key, F.lit(" looks like content, not an identifier"))))
        .otherwise(F.when((size > MAX_TEXT) | _is_prose(value), F.concat(
            path, F.lit(": free-text value of "), size.cast("string"), F.lit(" chars may be content"))))
    )
    return F.array_compact(F.array(finding))


def _walk(value: Column, dtype: T.DataType, key: Column, path: Column) -> Column | None:
    """Findings of a value of any type, or None when it holds no strings."""
    if isinstance(dtype, T.StringType):
        return _judge(value, key, path)
    if isinstance(dtype, T.StructType):
        parts = [
            _walk(value[f.name], f.dataType, F.lit(f.name), F.concat(path, F.lit(f".{f.name}")))
            for f in dtype.fields
        ]
    elif isinstance(dtype, T.ArrayType):
        probe = _walk(F.lit(None), dtype.elementType, key, path)
        if probe is None:
            return None
        # Items keep the key of their list.
        parts = [F.flatten(F.transform(value, lambda e, i: _walk(
            e, dtype.elementType, key,
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))]
    elif isinstance(dtype, T.MapType):
        if _walk(F.lit(None), dtype.valueType, key, path) is None:
            return None
        parts = [F.flatten(F.transform(F.map_entries(value), lambda e: _walk(
            e["value"], dtype.valueType, e["key"].cast("string"),
            F.concat(path, F.lit("."), e["key"].cast("string")))))]
    elif isinstance(dtype, T.VariantType):
        return _judge(F.to_json(value), key, path)
    else:
        return None
    none = F.array().cast("array<string>")
    found = [F.coalesce(p, none) for p in parts if p is not None]
    return F.concat(*found) if found else None


def scan_metadata_only(df: DataFrame, *, name: str = "bundle") -> DataFrame:
    """Add ``findings``: suspected content in any string of the row, at any depth."""
    none = F.array().cast("array<string>")
    parts = [
        _walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), F.lit(f"{name}.{f.name}"))
        for f in df.schema.fields
    ]
    found = [F.coalesce(p, none) for p in parts if p is not None]
    return df.withColumn("findings", F.concat(*found) if found else none)


def quarantine(df: DataFrame, *, name: str = "bundle") -> tuple[DataFrame, DataFrame]:
    """(rows that may leave, rows held back with their findings)."""
    scanned = scan_metadata_only(df, name=name)
    return scanned.filter(F.size("findings") == 0).drop("findings"), scanned.filter(F.size("findings") > 0)


def assert_metadata_only(df: DataFrame, *, name: str = "bundle") -> DataFrame:
    """The same rows; running them fails when any carries suspected content."""
    scanned = scan_metadata_only(df, name=name)
    fail = F.raise_error(F.concat(
        F.lit(f"{name} blocked from export, suspected content: "), F.array_join("findings", "; ")))
    checked = scanned.withColumn(
        "findings", F.when(F.size("findings") == 0, F.col("findings")).otherwise(fail.cast("array<string>")))
    return checked.filter(F.size("findings") == 0).drop("findings")
