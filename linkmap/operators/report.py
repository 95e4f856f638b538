"""Text reports of metrics and paths; all of them are small."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The labels of the metrics table, and how the mean is shown.
ASSEMBLY_LABELS = [("n", "Sequences"), ("total", "Total length"), ("max", "Largest"), ("min", "Smallest"), ("mean", "Mean"), ("n50", "N50"), ("n75", "N75"), ("ng50", "NG50"), ("ng75", "NG75"), ("l50", "L50"), ("l75", "L75")]


def metrics_tsv(metrics: DataFrame, mean_format: str = "%.0f") -> str:
    """A line for each metric; NG lines only where they are set."""
    r = metrics.first().asDict()
    return "".join(f"{label}\t{mean_format % r[k] if k == 'mean' else r[k]}\n" for k, label in ASSEMBLY_LABELS if r.get(k) is not None)


def metrics_json(physical: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> str:
    out = {"physical_map": physical.first().asDict()}
    if before is not None:
        out["assembly_before"] = before.first().asDict()
    if after is not None:
        out["assembly_after"] = after.first().asDict()
    return json.dumps(out, indent=2)


def merge_json(tables: dict[str, str]) -> str:
    """Two-column tables as one object of strings."""
    return json.dumps({name: dict(line.split("\t", 1) for line in text.splitlines() if "\t" in line) for name, text in tables.items()}, indent=2)


def path_lines(paths: DataFrame) -> DataFrame:
    """(tid, line): a path's molecules, with blanks between."""
    return paths.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tpos", "mol"))), lambda x: x["mol"]), " ").alias("line"))


def backbone_dot(paths: DataFrame) -> str:
    """A cluster for each path of two molecules and more; paths stream to the driver one by one."""
    out = ["graph backbone {"]
    for r in path_lines(paths).orderBy("tid").toLocalIterator():
        mols = r["line"].split(" ")
        if len(mols) >= 2:
            out.append(f"  subgraph cluster_{r['tid']} {{")
            out.append("    " + " -- ".join(f'"{m}"' for m in mols) + ";")
            out.append("  }")
    return "\n".join([*out, "}", ""])


def backbone_svg(paths: DataFrame, width: int = 800, bar: int = 12) -> str:
    """A bar for each path, coloured by length."""
    sizes = [r["n"] for r in paths.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tid").collect()]
    top = max(sizes, default=1)
    shade = lambda n: "#2b6cb0" if n >= 1000 else "#2f855a" if n >= 100 else "#a0aec0"
    bars = "".join(f'<rect x="0" y="{i * (bar + 2)}" width="{max(1, width * n // top)}" height="{bar}" fill="{shade(n)}"><title>{n}</title></rect>' for i, n in enumerate(sizes))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{len(sizes) * (bar + 2)}">{bars}</svg>'


def html_report(before: DataFrame, after: DataFrame, title: str = "Assembly") -> str:
    """A table of metrics before and after, with their change in percent."""
    b, a = before.first().asDict(), after.first().asDict()

    def change(k: str) -> str:
        return f"{100 * (a[k] - b[k]) / b[k]:+.1f} %" if b.get(k) and a.get(k) is not None else ""

    rows = "".join(f"<tr><td>{label}</td><td>{b[k]}</td><td>{a[k]}</td><td>{change(k)}</td></tr>" for k, label in ASSEMBLY_LABELS if b.get(k) is not None)
    return f"<!DOCTYPE html><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr><th>Metric</th><th>Before</th><th>After</th><th>Change</th></tr>{rows}</table>"
