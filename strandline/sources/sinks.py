"""Sinks: JSON rows, Mermaid, a self-contained page, a drift brief, and baseline tables."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def mermaid(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(diagram): a flow chart of (source, target, kind) in a fixed order; labels escaped and cut."""
    def label(name: str):
        plain = F.regexp_replace(F.col(name), r"[\"\[\]{}|<>`]", "'")
        return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit - 1), F.lit("…"))).otherwise(plain)

    def node(name: str):
        return F.concat(F.lit("n"), F.substring(F.sha1(F.col(name)), 1, 8), F.lit('["'), label(name), F.lit('"]'))

    line = F.concat(F.lit("  "), node("source"), F.lit(" -->|"), F.col("kind"), F.lit("| "), node("target"))
    return edges.select(line.alias("line")).agg(
        F.concat(F.lit("flowchart LR\n"), F.array_join(F.sort_array(F.collect_set("line")), "\n")).alias("diagram")
    )


#: Rows that a page holds.
MOST_DRAWN = 20_000


def html_graph(nodes: DataFrame, edges: DataFrame, title: str, most: int = MOST_DRAWN) -> str:
    """A page with the graph's data and a list view; for capped graphs (see ``cap_by_degree``), others are refused."""
    for rows in (nodes, edges):
        if rows.limit(most + 1).count() > most:
            raise ValueError(f"a page holds at most {most} nodes and {most} edges: cap the graph by degree first")
    data = {"nodes": [r.asDict(True) for r in nodes.collect()], "edges": [r.asDict(True) for r in edges.collect()]}
    rows = "".join(f"<li>{html.escape(str(n['label']))} ({n['degree']})</li>" for n in data["nodes"])
    payload = json.dumps(data).replace("</", "<\\/")
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"
        f"<ul>{rows}</ul><script type=application/json id=graph>{payload}</script>"
    )


def drift_brief(drift: DataFrame) -> str:
    """Markdown by note and severity of (note, symbol, path, grade, severity)."""
    out, note = ["# Drift"], None
    for r in drift.orderBy("note", "severity", "path", "symbol").toLocalIterator():
        if r["note"] != note:
            note = r["note"]
            out.append(f"\n## {note}")
        out.append(f"- **{r['grade']}** `{r['symbol'] or r['path']}` in {r['path']}")
    return "\n".join(out) + "\n"


def write_version(df: DataFrame, root: str) -> str:
    """Write a new version of a table, then move the pointer file to it; readers never see half a table."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.tmp")
    fs = path.getFileSystem(conf)
    stream = fs.create(path, True)
    stream.write(version.encode())
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    fs.delete(final, False)
    fs.rename(path, final)
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}")
