"""The declared constraints as a report.

Each finding is one row (rule, table_name, n); rules that hold come with 0.

Every table is read once for all its rules: each row becomes a cell (rule, value) for
each of its keys and references, and one for each rule of its own that it breaks. Cells
of all tables are counted in one shuffle; a value that fills a third of a table arrives
as one cell of each task. References then meet the keys of all parent tables in one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordered
from ..functions.stats import count_rows, or_zero
from ..schema import CONSTRAINTS
from ..sources.tables import Tables

_RULES = "table_name STRING, rule STRING, kind STRING, parent STRING"


@ordered("table_name", "rule")
def integrity_audit(t: Tables) -> DataFrame:
    """Check keys, references, required columns, lengths and tap order."""
    frames = {name: t.present()[name] for name in CONSTRAINTS if name in t.names()}
    rules = [rule for name in frames for rule in _rules(name, frames)]
    numbered = {rule[:2]: number for number, rule in enumerate(rules)}
    cells = reduce(
        DataFrame.unionByName, [_cells(n, f, numbered) for n, f in frames.items()]
    )
    counted = cells.groupBy("rule_id", "value").agg(count_rows().alias("rows"))

    spark = next(iter(frames.values())).sparkSession
    declared = spark.createDataFrame(
        [(number, *rule) for number, rule in enumerate(rules)], f"rule_id INT, {_RULES}"
    )
    parents = {rule[3] for rule in rules if rule[3] is not None}
    known = [
        frames[p].select(
            F.lit(p).alias("parent"),
            F.col(CONSTRAINTS[p].key).cast("string").alias("value"),
            F.lit(True).alias("found"),
        )
        for p in sorted(parents)
    ]
    told = counted.join(F.broadcast(declared), "rule_id")  # a row for each rule
    if known:
        keys = reduce(DataFrame.unionByName, known).distinct()
        told = told.join(keys, ["parent", "value"], "left")
    else:
        told = told.withColumn("found", F.lit(None).cast("boolean"))
    broken = (
        F.when(F.col("kind") == "row", F.col("rows"))
        .when(F.col("kind") == "key", F.col("rows") - 1)
        .when(F.col("found").isNull(), F.col("rows"))
    )
    sums = told.groupBy("rule_id").agg(F.sum(broken).alias("n"))
    return declared.join(sums, "rule_id", "left").select(
        "rule", "table_name", or_zero(F.col("n")).cast("bigint").alias("n")
    )


def _rules(name: str, frames: dict[str, DataFrame]) -> list[tuple]:
    """(table, rule, kind, parent) of every rule that the given tables can break."""
    given = CONSTRAINTS[name]
    columns = frames[name].columns
    found = [(name, rule, "row", None) for rule in _row_rules(name, columns)]
    found += [
        (name, f"duplicate:{c}", "key", None) for c in (given.key, *given.unique) if c in columns
    ]
    found += [
        (name, f"orphan:{c}->{parent}", "reference", parent)
        for c, parent in given.references
        if c in columns and parent in frames
    ]
    return found


def _row_rules(name: str, columns: list[str]) -> dict[str, Column]:
    """Rules that look at one row, and when it breaks them."""
    given = CONSTRAINTS[name]
    broken: dict[str, Column] = {}
    for column in (given.key, *given.required):
        if column in columns:
            broken[f"null:{column}"] = F.col(column).isNull()
    for column, longest in given.lengths.items():
        if column in columns:
            broken[f"length:{column}"] = F.length(column) > longest
    if name == "trips":
        broken["tap_out_before_tap_in"] = F.col("tap_out_time") < F.col("tap_in_time")
    return broken


def _cells(name: str, frame: DataFrame, numbered: dict[tuple, int]) -> DataFrame:
    """(rule_id, value) of each row: its keys, its references, the rules it breaks."""
    cells = []
    broken = _row_rules(name, frame.columns)
    for (table, rule), number in numbered.items():
        if table != name:
            continue
        if rule in broken:
            value, there = F.lit(None).cast("string"), broken[rule]
        else:
            column = rule.split(":")[1].split("->")[0]
            value, there = F.col(column).cast("string"), F.col(column).isNotNull()
        cell = F.struct(F.lit(number).alias("rule_id"), value.alias("value"))
        cells.append(F.when(there, cell))
    return frame.select(F.explode(F.array(*cells)).alias("cell")).where(
        "cell is not null"
    ).select("cell.rule_id", "cell.value")
