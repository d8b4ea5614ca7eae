"""Graph documents in DOT and result records in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A DOT string: backslash, quote and control characters escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def statement(head: Column, **attributes: Column) -> Column:
    """A node or edge statement with attributes."""
    if not attributes:
        return F.concat(F.lit("  "), head, F.lit(";"))
    inner = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v) for k, v in attributes.items()])
    return F.concat(F.lit("  "), head, F.lit(" ["), inner, F.lit("];"))


def document(lines: DataFrame, name: str, *keys: str, directed: bool = True) -> DataFrame:
    """(keys, document) of (keys, place, line) rows: one DOT text for each graph, lines in order of place and text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n")
    kind = "digraph" if directed else "graph"
    return lines.groupBy(*keys).agg(F.concat(F.lit(f'{kind} "{name}" {{\n'), body, F.lit("\n}\n")).alias("document"))


def cfg_document(placed: DataFrame, cfg: DataFrame) -> DataFrame:
    """(code_id, document): blocks with their id, start and offsets; exception edges with their stack depth."""
    offs = F.array_join(F.transform(F.array_sort(F.collect_list("off")), lambda x: x.cast("string")), " ")
    b = placed.groupBy("code_id", "block_id").agg(F.min("off").alias("start"), offs.alias("offs"))
    node = statement(F.concat(F.lit("b"), F.col("block_id").cast("string")), label=quoted(F.concat(F.lit("B"), F.col("block_id").cast("string"), F.lit(" @"), F.col("start").cast("string"), F.lit("\n"), F.col("offs"))))
    label = F.when(F.col("kind") == "Exception", F.concat(F.col("kind"), F.lit(" depth "), F.col("stack_depth").cast("string"))).otherwise(F.col("kind"))
    edge = statement(F.concat(F.lit("b"), F.col("src").cast("string"), F.lit(" -> b"), F.col("dst").cast("string")), label=quoted(label))
    lines = b.select("code_id", F.col("block_id").cast("long").alias("place"), node.alias("line"))
    return document(lines.unionByName(cfg.select("code_id", (F.lit(1 << 40) + F.col("src") * (1 << 20) + F.col("dst")).alias("place"), edge.alias("line"))), "cfg", "code_id")


def cdg_document(cdg: DataFrame) -> DataFrame:
    edge = statement(F.concat(F.lit("b"), F.col("controller").cast("string"), F.lit(" -> b"), F.col("dependent").cast("string")), label=quoted(F.col("outcome")))
    return document(cdg.select("code_id", (F.col("controller") * (1 << 20) + F.col("dependent")).alias("place"), edge.alias("line")), "cdg", "code_id")


def cg_lines(edges: DataFrame) -> DataFrame:
    """(place, line) of (site, caller, target, label) edges: nodes once, a dashed edge to an unknown node of its own for each site without target."""
    nodes = edges.select(F.col("caller").alias("n")).unionByName(edges.where("target IS NOT NULL").select(F.col("target").alias("n"))).distinct()
    node = nodes.select(F.lit(0).alias("place"), statement(F.concat(F.lit("c"), F.col("n").cast("string"))).alias("line"))
    known = edges.where("target IS NOT NULL").select(F.lit(1).alias("place"), statement(F.concat(F.lit("c"), F.col("caller").cast("string"), F.lit(" -> c"), F.col("target").cast("string"))).alias("line")).distinct()
    open_ = edges.where("target IS NULL")
    unknown = open_.select(F.lit(2).alias("place"), statement(F.concat(F.lit("u"), F.col("site").cast("string")), label=quoted(F.col("label"))).alias("line"))
    dashed = open_.select(F.lit(3).alias("place"), statement(F.concat(F.lit("c"), F.col("caller").cast("string"), F.lit(" -> u"), F.col("site").cast("string")), style=F.lit("dashed")).alias("line"))
    return node.unionByName(known).unionByName(unknown).unionByName(dashed)


def ddg_document(nodes: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """Data-dependence graphs of nodes (keys, node, kind, label) and edges (keys, src, dst, kind)."""
    node = nodes.select(*keys, F.col("node").alias("place"), statement(F.concat(F.lit("n"), F.col("node").cast("string")), label=quoted(F.concat_ws(" ", "kind", "label"))).alias("line"))
    edge = edges.select(*keys, (F.lit(1 << 50) + F.col("src") * (1 << 24) + F.col("dst")).alias("place"), statement(F.concat(F.lit("n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string")), label=quoted(F.col("kind"))).alias("line"))
    return document(node.unionByName(edge), "ddg", *keys)


def record(df: DataFrame, name: str = "record") -> DataFrame:
    """Rows as JSON texts, columns in order."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as text files; a run that fails leaves no result."""
    df.select(column).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON, CSV or Parquet files."""
    w = df.write.mode("overwrite")
    {"json": w.json, "parquet": w.parquet, "csv": lambda p: w.option("header", True).csv(p)}[kind](path)
