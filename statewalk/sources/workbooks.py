"""Subject workbooks (.xlsx) and other series files as observation tables.

Observations have the columns subject_id, group, file, timepoint and one double per signal.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk import config
from statewalk.operators.ordering import ordered_index
from statewalk.session import materialize

SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PART_SCHEMA = "path string, names array<string>, timepoint bigint, x array<double>"
ROWS_PER_BATCH = 10000
GLOB = "*.[xX][lL][sS][xX]"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _first_sheet(archive: zipfile.ZipFile) -> str:
    sheets = [n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return min(sheets, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group()))


def read_workbook(content: bytes, label: str) -> tuple[list[str], np.ndarray]:
    """Header names and the numeric matrix of the first sheet. Anything that is not a complete
    finite number below the header is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            strings = [
                "".join(t.text or "" for t in item.iter(SHEET_NS + "t"))
                for item in root.iter(SHEET_NS + "si")
            ]
        names: list[str] = []
        rows: list[list[float]] = []
        with archive.open(_first_sheet(archive)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != SHEET_NS + "row":
                    continue
                cells: dict[int, object] = {}
                for at, cell in enumerate(row.iter(SHEET_NS + "c")):
                    column = _column_number(cell.get("r")) if cell.get("r") else at
                    value = cell.find(SHEET_NS + "v")
                    kind = cell.get("t", "n")
                    if kind == "inlineStr":
                        cells[column] = "".join(t.text or "" for t in cell.iter(SHEET_NS + "t"))
                    elif value is not None and value.text is not None:
                        if kind == "s":
                            cells[column] = strings[int(value.text)]
                        else:
                            cells[column] = float(value.text) if kind == "n" else value.text
                row.clear()
                if not cells:
                    continue
                if not names:
                    names = [str(cells.get(c, "")) for c in range(max(cells) + 1)]
                    continue
                values = [cells.get(c) for c in range(len(names))]
                bad = [names[c] for c, v in enumerate(values) if isinstance(v, str)]
                if bad:
                    raise ValueError(f"{label}: not numbers in {', '.join(bad)}")
                rows.append([np.nan if v is None else v for v in values])
    x = np.array(rows, dtype=float).reshape(len(rows), len(names))
    if len(x) < 2:
        raise ValueError(f"{label}: needs two rows of values or more")
    if x.shape[1] < 2:
        raise ValueError(f"{label}: needs two columns or more")
    if not np.isfinite(x).all():
        raise ValueError(f"{label}: holds empty or infinite cells")
    return names, x


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            names, x = read_workbook(content, path.rsplit("/", 1)[-1])
            for at in range(0, len(x), ROWS_PER_BATCH):
                part = x[at : at + ROWS_PER_BATCH]
                yield pd.DataFrame(
                    {
                        "path": path, "names": [names] * len(part),
                        "timepoint": np.arange(at + 1, at + len(part) + 1), "x": list(part),
                    }
                )


def _numbered_files(files: DataFrame, hot_rows: int) -> DataFrame:
    """(path, group, file, subject_id): patients first, then controls, each by file name."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", "group", name.alias("file"))
    placed = ordered_index(
        listed, "group", ["file", "path"],
        {"head": F.substring("file", 1, 4), "more": F.substring("file", 1, 8)},
        out="position", hot_rows=hot_rows,
    )
    n_target = listed.filter(F.col("group") == config.TARGET_GROUP).agg(F.count(F.lit(1))).scalar()
    offset = F.when(F.col("group") == config.TARGET_GROUP, F.lit(0)).otherwise(n_target)
    return placed.select("path", "group", "file", (F.col("position") + offset).alias("subject_id"))


def read_workbooks(
    spark: SparkSession,
    root: str | None = None,
    target_dir: str = "data/Patients",
    reference_dir: str = "data/Controls",
    hot_rows: int = config.HOT_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Observations and ROI names from one workbook per subject; the folder gives the group.
    Workbooks are decoded in parallel, one file at a time per task (the format itself ends at about
    a million rows)."""
    base = config.project_root(root)
    parts = []
    for folder, group in (
        (target_dir, config.TARGET_GROUP), (reference_dir, config.REFERENCE_GROUP)
    ):
        part = (
            spark.read.format("binaryFile").option("pathGlobFilter", GLOB)
            .load(f"{base}/{folder}").withColumn("group", F.lit(group))
        )
        if part.select("path").isEmpty():
            raise FileNotFoundError(f"no .xlsx files found in {folder}")
        parts.append(part)
    files = parts[0].unionByName(parts[1])
    # Written once: every workbook is decoded a single time, whatever is done with the rows.
    rows = materialize(files.select("path", "content").mapInPandas(_parse, PART_SCHEMA), "workbooks")
    seen = rows.agg(F.min("names").alias("a"), F.max("names").alias("b")).first()
    if seen["a"] != seen["b"]:
        raise ValueError("workbooks disagree on their column names")
    names = list(seen["a"])
    numbered = _numbered_files(files.select("path", "group"), hot_rows)
    observations = rows.join(numbered, "path").select(
        "subject_id", "group", "file", "timepoint",
        *[F.get("x", F.lit(i)).alias(f"x{i + 1}") for i in range(len(names))],
    )
    return observations, names
