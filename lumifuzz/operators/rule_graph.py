"""What sets a rule base uses, and together with which others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.operators.rules import RuleBase


def used(base: RuleBase, spark: SparkSession) -> DataFrame:
    """rule, consequent, variable, label: one row for each antecedent."""
    return base.frame(spark).select("rule", "consequent", F.posexplode("antecedents").alias("variable", "label")).where("label >= 0")


def histogram(base: RuleBase, spark: SparkSession) -> DataFrame:
    """variable, label, n."""
    return used(base, spark).groupBy("variable", "label").agg(F.count("*").alias("n"))


def most_popular(base: RuleBase, spark: SparkSession) -> tuple[int, int] | None:
    """The most used (variable, label); the first of equals."""
    r = histogram(base, spark).orderBy(F.desc("n"), "variable", "label").first()
    return (r["variable"], r["label"]) if r else None


def popular_rules(base: RuleBase, spark: SparkSession) -> list[int]:
    """The places of the rules that use it."""
    top = most_popular(base, spark)
    return [] if top is None else [i for i, r in enumerate(base.rules) if r.antecedents[top[0]] == top[1]]


def connections(base: RuleBase, spark: SparkSession) -> DataFrame:
    """class, from_variable, from_label, to_variable, to_label, weight: half for each rule of the class that uses both sets."""
    a = used(base, spark)
    b = a.select(F.col("rule").alias("_r"), F.col("variable").alias("to_variable"), F.col("label").alias("to_label"))
    pairs = a.join(b, (a["rule"] == b["_r"]) & (F.struct("variable", "label") != F.struct("to_variable", "to_label")))
    return pairs.groupBy(F.col("consequent").alias("class"), F.col("variable").alias("from_variable"), F.col("label").alias("from_label"), "to_variable", "to_label").agg((F.count("*") / 2).alias("weight"))


def named_edges(base: RuleBase, spark: SparkSession) -> DataFrame:
    """source, target, class, weight with readable names: the graph as a table to export."""
    names = spark.createDataFrame([(i, j, f"{v.name} {s.name}") for i, v in enumerate(base.variables) for j, s in enumerate(v.sets)], "v int, l int, name string")
    e = connections(base, spark)
    e = e.join(F.broadcast(names), (F.col("from_variable") == F.col("v")) & (F.col("from_label") == F.col("l"))).withColumnRenamed("name", "source").drop("v", "l")
    e = e.join(F.broadcast(names), (F.col("to_variable") == F.col("v")) & (F.col("to_label") == F.col("l"))).withColumnRenamed("name", "target").drop("v", "l")
    return e.select("source", "target", "class", "weight")


def gexf(base: RuleBase, spark: SparkSession) -> str:
    """The graph in GEXF."""
    from xml.sax.saxutils import quoteattr

    edges = sorted((r["source"], r["target"], float(r["weight"])) for r in named_edges(base, spark).groupBy("source", "target").agg(F.sum("weight").alias("weight")).collect())
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    body = [f"<node id={quoteattr(n)} label={quoteattr(n)}/>" for n in nodes]
    lines = [f'<edge id="{i}" source={quoteattr(a)} target={quoteattr(b)} weight="{w}"/>' for i, (a, b, w) in enumerate(edges)]
    return f'<?xml version="1.0" encoding="UTF-8"?><gexf version="1.2"><graph defaultedgetype="undirected"><nodes>{"".join(body)}</nodes><edges>{"".join(lines)}</edges></graph></gexf>'


def rule_table(base: RuleBase, spark: SparkSession, used_only: bool = True) -> DataFrame:
    """A column for each variable with the set's name (null: any), then class and score; used_only: without variables that no rule uses."""
    frame = base.frame(spark)
    columns = []
    for i, v in enumerate(base.variables):
        if not used_only or any(r.antecedents[i] >= 0 for r in base.rules):
            said = F.lit(None).cast("string")
            for j, s in enumerate(v.sets):
                said = F.when(F.col("antecedents")[i] == j, s.name).otherwise(said)
            columns.append(said.alias(v.name))
    return frame.select("rule", *columns, "class", "score")
