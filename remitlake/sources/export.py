"""Results as CSV: one directory per named sheet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def _folder(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_")


def write_csv(df: DataFrame, path: str, one_file: bool = False, packed: bool = False) -> None:
    """Header row, no index. ``one_file`` suits report tables of a few thousand rows only;
    row-level exports are written by as many tasks as the data has partitions. ``packed`` writes each file as gzip, with
    little effort; such a file is read by one task, so the data needs partitions enough."""
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"')
    if packed:
        writer = writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.csv(path)


def write_sets(sets: dict[str, dict[str, DataFrame]], root: str) -> list[str]:
    """``root/<set>/<sheet>/*.csv`` for every sheet; returns the folders."""
    folders = []
    for label, sheets in sets.items():
        for sheet, frame in sheets.items():
            path = f"{root}/{_folder(label)}/{_folder(sheet)}"
            write_csv(frame, path)
            folders.append(path)
    return folders
