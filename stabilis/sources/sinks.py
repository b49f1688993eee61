"""Result files: CSV, JSON sidecars, Markdown reports. Data is written by Spark, small documents by the driver."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """CSV with a header; an existing target is an error."""
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', compression="gzip" if compressed else "none")


def append_by_essay(df: DataFrame, path: str) -> None:
    """Append Parquet rows partitioned by essay: the unit in which an interrupted run resumes."""
    df.write.mode("append").partitionBy("essay_file").parquet(path)


def clean(data):
    """JSON-ready copy: keys as text, numbers that are not finite as null."""
    if isinstance(data, dict):
        return {str(k): clean(v) for k, v in data.items()}
    if isinstance(data, (list, tuple)):
        return [clean(v) for v in data]
    if hasattr(data, "item"):
        data = data.item()
    return None if isinstance(data, float) and not math.isfinite(data) else data


def write_metadata(path: str, data: dict) -> str:
    """Sidecar of a result file, replaced in one step."""
    target = os.path.splitext(path)[0] + ".metadata.json"
    with open(target + ".part", "w", encoding="utf-8") as f:
        json.dump(clean(data), f, indent=2)
    os.replace(target + ".part", target)
    return target


def markdown_lines(df: DataFrame, most: int | None = None) -> Iterator[str]:
    """The lines of a Markdown table, all rows in their order; the driver holds a partition at a time. With ``most``, so many
    rows and a line that says that more follow."""
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    yield "| " + " | ".join(df.columns) + " |"
    yield "|" + " --- |" * len(df.columns)
    for n, r in enumerate(df.toLocalIterator()):
        if n == most:
            yield ""
            yield f"More than {most} rows; see the data."
            return
        yield "| " + " | ".join(cell(v) for v in r) + " |"


def markdown(df: DataFrame, most: int | None = None) -> str:
    """The lines of ``markdown_lines`` as one text."""
    return "\n".join(markdown_lines(df, most))


def write_report(path: str, sections: dict[str, DataFrame], title: str = "Stability report") -> str:
    """One section per result table, all rows of each, line by line."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(f"# {title}\n")
        for name, df in sections.items():
            f.write(f"\n## {name}\n\n")
            f.writelines(line + "\n" for line in markdown_lines(df))
    return path


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append vector rows after their rules hold; a broken rule writes nothing."""
    from stabilis.sources.tables import vector_violations

    if broken := [r["rule"] for r in vector_violations(vectors).collect()]:
        raise ValueError(f"vector rows break rules: {', '.join(sorted(broken))}")
    append_by_essay(vectors, path)


def numbered(units: DataFrame, key: str, label: str = "label", most: int | None = None) -> str:
    """Markdown of text units (key, label, pos, text): a heading per text and label, then its units in order. With ``most``,
    so many units and a line that says that more follow."""
    lines, last = [], (None, None)
    for n, r in enumerate(units.orderBy(key, label, "pos").toLocalIterator()):
        if n == most:
            lines += ["", f"More than {most} units; see the data."]
            break
        if r[key] != last[0]:
            lines += [f"## Filename: {r[key]}", ""]
        if (r[key], r[label]) != last:
            lines += [f"### {r[label]}", ""]
        last = (r[key], r[label])
        lines.append(f"{r['pos'] + 1}. {r['text']}")
    return "\n".join(lines)


def match_log(matches: DataFrame, keys: list[str], most: int | None = None) -> str:
    """Markdown of matches in their order: by pair, first unit, falling score, second unit."""
    return markdown(matches.orderBy(*keys, "i", F.desc("score"), "j"), most)


def calibration_report(scores: DataFrame, metrics: list[str], key: str = "filename") -> str:
    """Markdown of section pairs (key, place, section_1, section_2, metrics): a table per text and one of means. The scores
    are read once, in order."""
    name = F.concat_ws("-", "section_1", "section_2").alias("comparison")
    head = ["| comparison | " + " | ".join(metrics) + " |", "|" + " --- |" * (len(metrics) + 1)]
    lines, last = [], None
    for r in scores.select(key, "place", name, *metrics).orderBy(key, "place").toLocalIterator():
        if r[key] != last:
            lines += [*([""] if lines else []), f"## {r[key]}", "", *head]
            last = r[key]
        lines.append("| " + " | ".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in (r[c] for c in ("comparison", *metrics))) + " |")
    means = scores.groupBy("place", name).agg(*[F.avg(m).alias(m) for m in metrics]).orderBy("place").drop("place")
    return "\n".join([*lines, *([""] if lines else []), "## Mean", "", markdown(means)]) + "\n"
