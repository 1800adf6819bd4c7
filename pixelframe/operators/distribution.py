"""Class statistics of labelled files."""

from __future__ import annotations

import math
import os
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.functions import names


def class_counts(files: DataFrame, extensions: tuple[str, ...] = names.DISTRIBUTION, classes: DataFrame | None = None) -> DataFrame:
    """``class, n``. With ``classes``, those without files are counted as zero."""
    counts = files.where(names.is_image(F.col("name"), extensions)).groupBy("class").agg(F.count("*").alias("n"))
    return counts if classes is None else classes.select("class").distinct().join(counts, "class", "left").na.fill(0, ["n"])


def shares(counts: DataFrame) -> DataFrame:
    """``class, n, pct``: the share of each class in per cent, 0 where there are no files."""
    # One row for each class: the window over all of them is as small as the report.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.when(total > 0, F.col("n") / total * 100).otherwise(F.lit(0.0)))


def with_total(files: DataFrame, extensions: tuple[str, ...] = names.DISTRIBUTION) -> DataFrame:
    """``class, n`` and a row of all classes, whose class is null."""
    return files.where(names.is_image(F.col("name"), extensions)).rollup("class").agg(F.count("*").alias("n"))


def distribution(files: DataFrame, root: str, root_files: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Shares by class; a root that holds images itself is one class, and its folders do not count."""
    if root_files is not None:
        direct = root_files.where(names.is_image(F.col("name"), names.DISTRIBUTION))
        if not direct.isEmpty():
            return shares(direct.groupBy(F.lit(root).alias("class")).agg(F.count("*").alias("n")))
    return shares(class_counts(files, classes=classes))


def _sorted(shares_of: DataFrame) -> list:
    """A row for each class is brought to the driver."""
    return sorted(shares_of.collect(), key=lambda row: str(row["class"]))


def report(shares_of: DataFrame) -> str:
    """The table as text, sorted by class."""
    rows = _sorted(shares_of)
    head, rule = f"{'Disease Type':<30} {'Count':>10} {'Percentage':>10}", "=" * 60
    lines = [f"{row['class']:<30} {row['n']:>10} {row['pct']:>9.1f}%" for row in rows]
    return "\n".join(["", rule, head, rule, *lines, "-" * 60, f"{'Total':<30} {sum(row['n'] for row in rows):>10} {'100.0%':>10}", rule, ""])


def chart(shares_of: DataFrame, title: str) -> str | None:
    """A pie of the shares beside bars of the counts, as SVG; None without classes."""
    rows = _sorted(shares_of)
    if not rows:
        return None
    most, total = max(row["n"] for row in rows) or 1, sum(row["n"] for row in rows) or 1
    colour = lambda k: f"hsl({360 * k // len(rows)},55%,70%)"
    parts, turned = [], 0.0
    for k, row in enumerate(rows):
        share, name = row["n"] / total, escape(str(row["class"]))
        place = lambda turn, r: f"{180 + r * math.sin(2 * math.pi * turn):.1f},{190 - r * math.cos(2 * math.pi * turn):.1f}"
        if share >= 1:
            parts.append(f'<circle cx="180" cy="190" r="120" fill="{colour(k)}"/>')
        elif share:
            parts.append(f'<path d="M180,190 L{place(turned, 120)} A120,120 0 {int(share > 0.5)} 1 {place(turned + share, 120)} Z" fill="{colour(k)}"/>')
        if share:
            at = place(turned + share / 2, 145).split(",")
            parts.append(f'<text x="{at[0]}" y="{at[1]}" text-anchor="middle">{name} {100 * share:.1f}%</text>')
        turned += share
        y = 70 + 24 * k
        parts.append(f'<rect x="520" y="{y}" width="{300 * row["n"] / most:.1f}" height="18" fill="{colour(k)}" stroke="black"/><text x="510" y="{y + 14}" text-anchor="end">{name}</text><text x="{526 + 300 * row["n"] / most:.1f}" y="{y + 14}">{row["n"]}</text>')
    size = f'width="920" height="{max(360, 100 + 24 * len(rows))}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif" font-size="12"><text x="20" y="24" font-weight="bold">{escape(title)} class distribution</text><text x="130" y="48">Distribution (%)</text><text x="520" y="48">Count</text>{"".join(parts)}</svg>'


def save_chart(shares_of: DataFrame, title: str, folder: str) -> str | None:
    """Writes the chart to ``folder`` (any file system that pyarrow knows) and returns its path."""
    from pyarrow import fs

    if (drawn := chart(shares_of, title)) is None:
        return None
    store, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
    store.create_dir(at)
    with store.open_output_stream(path := f"{at}/{title}_class_distribution.svg", compression=None) as file:
        file.write(drawn.encode())
    return path
