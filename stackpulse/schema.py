"""Declared schemas, ingest renames and name checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

N_CELLS = 96

# Field names of the telemetry records.
STACK_CONDITIONS = [
    "Load", "Loaddensity", "H2Flow", "TstackIn", "TstackOut",
    "CoolantFlow", "AnodePressureDiff", "CathodePressureDiff", "RH_An", "RH_Cat",
]
AGEING_FIELDS = [
    "Time (h)", "TinH2 (°C)", "ToutH2 (°C)", "TinAIR (°C)", "ToutAIR (°C)",
    "TinWAT (°C)", "ToutWAT (°C)", "PinAIR (mbara)", "PoutAIR (mbara)",
    "PoutH2 (mbara)", "PinH2 (mbara)", "DinH2 (l/mn)", "DoutH2 (l/mn)",
    "DinAIR (l/mn)", "DoutAIR (l/mn)", "DWAT (l/mn)", "HrAIRFC (%)",
]
AGEING_TARGETS = ["U1 (V)", "U2 (V)", "U3 (V)", "U4 (V)", "U5 (V)", "J (A/cm²)", "I (A)", "Utot (V)"]
FAULT_FIELDS = [
    "AOP1", "AOP2", "COP1", "COP2", "I", "ARF", "AIP1", "AIP2", "CAIF", "CIP1",
    "CS", "COT2", "CIT2", "COT1", "CIT1", "WIP2", "WIP1", "WIF2", "WIF1", "WIT",
]
REPORT_COLUMNS = ["Date_Time", "Min_Cell_Voltage", "Min_Cell_Index", *STACK_CONDITIONS]

# Input ranges of the transient-fault form (field, low, high).
FAULT_RANGES = {
    "I": (0, 200), "ARF": (0, 500), "AIP1": (0, 3000), "AIP2": (0, 3000),
    "CAIF": (0, 2000), "CIP1": (0, 2000), "CS": (0, 10), "COT2": (0, 100),
    "CIT2": (0, 100), "COT1": (0, 100), "CIT1": (0, 100), "WIP2": (0, 3000),
    "WIP1": (0, 3000), "WIF2": (0, 1000), "WIF1": (0, 1000), "WIT": (0, 100),
}


def _doubles(names: Iterable[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


STACK_WIDE = T.StructType(
    [T.StructField("Date_Time", T.StringType())]
    + _doubles(STACK_CONDITIONS)
    + _doubles(f"Cell{i}" for i in range(1, N_CELLS + 1))
)
STACK_RECORD = T.StructType(
    [T.StructField("Date_Time", T.StringType())]
    + _doubles(STACK_CONDITIONS)
    + [T.StructField("Cell_Voltages", T.ArrayType(T.DoubleType()))]
)
AGEING = T.StructType(_doubles(AGEING_FIELDS + AGEING_TARGETS))
SERIES = T.StructType(
    [T.StructField("time", T.StringType())] + _doubles(["current", "voltage", "power"])
)
FAULT = T.StructType(_doubles(FAULT_FIELDS) + [T.StructField("fault", T.IntegerType())])
FAULT_RECORD = T.StructType([T.StructField("features", T.MapType(T.StringType(), T.DoubleType()))])


def snake(name: str) -> str:
    """Plan-safe column name: ``TinH2 (°C)`` becomes ``tinh2_c``.

    A superscript two that was decoded as Latin-1 (``Â²``) gives the same name
    as the correct spelling.
    """
    text = name.replace("Â", "").replace("²", "2").replace("°", "").replace("%", "pct")
    return re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")


def rename_snake(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename every column to snake case; also return new name -> old name."""
    mapping = {c: snake(c) for c in df.columns}
    if len(set(mapping.values())) != len(mapping):
        raise ValueError(f"column names collide after renaming: {sorted(mapping.values())}")
    return df.withColumnsRenamed(mapping), {new: old for old, new in mapping.items()}


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def with_missing_as_zero(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add each absent feature column as 0.0."""
    absent = {n: F.lit(0.0) for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    names = list(names)
    return require_columns(df, names).select(*names)


def exclude_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)
