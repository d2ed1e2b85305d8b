"""Writing results."""

from __future__ import annotations

import logging
import os
import shutil

from pyspark.sql import DataFrame, functions as F

from themeweave.functions.text import clean_control

log = logging.getLogger(__name__)
#: Most rows a spreadsheet or HTML report may have.
REPORT_ROWS = 100_000


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV needs them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, *, best_effort: bool = False) -> bool:
    try:
        df.write.mode("overwrite").parquet(path)
        return True
    except Exception as e:  # noqa: BLE001
        if not best_effort:
            raise
        log.warning("no Parquet written to %s: %s", path, e)
        return False


def clean_strings(df: DataFrame) -> DataFrame:
    """Control signs that spreadsheets refuse removed from all text columns."""
    return df.withColumns({c: clean_control(c) for c, t in df.dtypes if t == "string"})


def _report(df: DataFrame):
    rows = df.limit(REPORT_ROWS + 1).toPandas()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows for a report")
    return rows


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """One sheet per table; needs a spreadsheet writer to be installed."""
    import pandas as pd

    try:
        with pd.ExcelWriter(path) as w:
            for name, df in sheets.items():
                _report(clean_strings(flat(df))).to_excel(w, sheet_name=name[:31], index=False)
    except ImportError as e:
        raise RuntimeError("writing XLSX needs a spreadsheet writer") from e


def write_html(df: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(_report(df).to_html(index=False))


def zip_folder(folder: str, target: str) -> str:
    """All files of a local folder in one archive; gives its path."""
    base = target[:-4] if target.endswith(".zip") else target
    return shutil.make_archive(os.path.abspath(base), "zip", folder)
