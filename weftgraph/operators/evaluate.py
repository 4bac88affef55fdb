"""Reports over results: averages, golden comparisons, algorithm tables, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import matcher
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern


def average(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.avg(column).alias("average"))


def mean_square_difference(values: DataFrame, column: str) -> DataFrame:
    """The sum of squared differences from the mean over n - 1; null for fewer than two values."""
    return values.agg(F.var_samp(column).alias("mean_square_difference"))


def average_of_reports(reports: DataFrame) -> DataFrame:
    """avg_matchings, avg_backtracking, n over reports (n_matches, n_backtracking); a missing field does not count."""
    return reports.agg(F.avg("n_matches").alias("avg_matchings"), F.avg("n_backtracking").alias("avg_backtracking"), F.count("*").alias("n"))


def differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """query, mapping, side ('missing' or 'unexpected'): mappings that only one of two results (query, mapping) has, as often as it has more of them."""
    a = actual.groupBy("query", "mapping").agg(F.count("*").alias("n"))
    e = expected.groupBy("query", "mapping").agg(F.count("*").alias("k"))
    both = a.join(e, ["query", "mapping"], "full").select("query", "mapping", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k")).filter("n <> k")
    return both.select("query", "mapping", F.when(F.col("n") < F.col("k"), "missing").otherwise("unexpected").alias("side"))


def compare_algorithms(runs: DataFrame) -> DataFrame:
    """algorithm, size, avg_matchings, avg_backtracking, n_graphs over runs (algorithm, size, n_matches, n_backtracking); runs out of memory have nulls and do not count."""
    return runs.groupBy("algorithm", "size").agg(F.avg("n_matches").alias("avg_matchings"), F.avg("n_backtracking").alias("avg_backtracking"), F.count("n_matches").alias("n_graphs"))


#: Enumerations and orders that a comparison goes through.
VARIANTS = (("quickSI", "graphQL"), ("DAF", "graphQL"), ("VEQs", "graphQL"), ("groundTruth", "graphQL"), ("quickSI", "quickSI"), ("quickSI", "groundTruth"), ("groundTruth", "dynamic"))


def run_comparison(graph: LabeledGraph, patterns: list[Pattern], induced: bool = True, variants=VARIANTS) -> DataFrame:
    """A run of each variant on each pattern, for compare_algorithms."""
    rows = []
    for enumeration, order in variants:
        for p in patterns:
            done = matcher.plan(graph, p, matcher.Config(enumeration=enumeration, order=order))
            calls = matcher.search_profile(done, induced).agg(F.sum("n_calls")).first()[0]
            rows.append((f"B_{enumeration}_PO_{order}_C_{done.config.candidates}", len(p.labels), done.count(induced).first()[0], int(calls)))
    return graph.vertices.sparkSession.createDataFrame(rows, "algorithm string, size int, n_matches long, n_backtracking long")


def parse_run_name(name):
    """(enumeration, candidate_order, candidates, size) columns from names like B_x_PO_y_C_z_size_n."""
    name = F.element_at(F.split(name, "/"), -1)
    part = lambda i: F.regexp_extract(name, r"^B_(.+)_PO_(.+)_C_(.+?)_size_(\d+)", i)
    return part(1).alias("enumeration"), part(2).alias("candidate_order"), part(3).alias("candidates"), part(4).cast("int").alias("size")


def size_table(comparison: DataFrame, value: str = "avg_backtracking") -> DataFrame:
    """A row for each size and a column for each algorithm; null where it ran out of memory."""
    return comparison.groupBy("size").pivot("algorithm").agg(F.first(value)).orderBy("size")


def size_table_text(comparison: DataFrame, value: str = "avg_backtracking") -> str:
    """The size table as rows of a LaTeX tabular."""
    table = size_table(comparison, value)
    rows = [table.columns, *[["" if v is None else f"{v:g}" for v in r] for r in table.collect()]]
    return "\n".join(" & ".join(str(c).replace("_", r"\_") for c in r) + r" \\" for r in rows)


def series(comparison: DataFrame) -> DataFrame:
    """algorithm, size, matchings, log_backtracking (natural), for lines by size."""
    return comparison.select("algorithm", "size", F.col("avg_matchings").alias("matchings"), F.when(F.col("avg_backtracking") > 0, F.log("avg_backtracking")).alias("log_backtracking"))


def heat_map(hard: DataFrame, sizes: DataFrame, most_degree: int = 6, most_diameter: int = 10) -> DataFrame:
    """size, de, di, n_graphs, mean_matchings over the whole grid.

    hard: size, de, di, status (also 'none', for cells that were tried in vain), estimate, n_isomorphic. n_graphs counts each hard graph and those of its shape; the mean weighs alike;
    cells without hard ones have null, cells that were not tried have -1.
    """
    weight = F.col("n_isomorphic") + 1
    is_hard = F.col("status") == "hard"
    cells = hard.groupBy("size", "de", "di").agg(F.sum(F.when(is_hard, weight)).alias("n_graphs"), (F.sum(F.when(is_hard, F.col("estimate") * weight)) / F.sum(F.when(is_hard, weight))).alias("mean_matchings"), F.lit(1).alias("there"))
    spark = hard.sparkSession
    grid = sizes.select("size").distinct().crossJoin(spark.range(1, most_degree + 1).select(F.col("id").cast("int").alias("de"))).crossJoin(spark.range(1, most_diameter + 1).select(F.col("id").cast("int").alias("di")))  # a grid of constants
    joined = grid.join(cells, ["size", "de", "di"], "left")
    missing = F.col("there").isNull()
    return joined.select("size", "de", "di", F.when(missing, F.lit(-1)).otherwise(F.col("n_graphs")).cast("long").alias("n_graphs"), F.when(missing, F.lit(-1.0)).otherwise(F.col("mean_matchings")).alias("mean_matchings"))


def heat_map_ends(grid: DataFrame, cap: float = 1e7) -> DataFrame:
    """low, high, true_high of the mean matchings, capped, without missing cells; n_capped, n_missing."""
    m = F.when(F.col("mean_matchings") >= 0, F.col("mean_matchings"))
    return grid.agg(F.min(F.least(m, F.lit(cap))).alias("low"), F.max(F.least(m, F.lit(cap))).alias("high"), F.max(m).alias("true_high"), F.count_if(m > cap).alias("n_capped"), F.count_if(F.col("mean_matchings") < 0).alias("n_missing"))


def probability_grid(lines: DataFrame) -> DataFrame:
    """size, degree, p from lines 'Size:n, Degree: d---p' (column value); other lines are left out."""
    part = lambda i: F.regexp_extract("value", r"Size:\s*(\d+),\s*Degree:\s*(\d+)---([0-9.eE+-]+)", i)
    return lines.filter(part(1) != "").select(part(1).cast("int").alias("size"), part(2).cast("int").alias("degree"), part(3).cast("double").alias("p"))


def probability_table(grid: DataFrame) -> DataFrame:
    return grid.groupBy("size").pivot("degree").agg(F.first("p")).orderBy("size")
