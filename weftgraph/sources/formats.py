"""Text formats of graphs and reports, read and written with Spark."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import materialised
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern

FORMATS = ("proteins", "igraph")


def parse_proteins(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """(vertices, edges) of the positional format: a count, that many 'id label', then for each vertex a count and that many 'a b'.

    Lines that are blank or start with # may stand anywhere. Edges may be listed from either end or both.
    """
    lines = [s for s in (x.strip() for x in text.splitlines()) if s and not s.startswith("#")]
    if not lines:
        return [], []
    n = int(lines[0].split()[0])
    vertices = [(int(p[0]), p[1] if len(p) > 1 else "") for p in (x.split() for x in lines[1 : n + 1])]
    edges, at = [], n + 1
    while at < len(lines):
        k = int(lines[at].split()[0])
        edges += [tuple(map(int, x.split()[:2])) for x in lines[at + 1 : at + 1 + k]]
        at += 1 + k
    return vertices, edges


def read_proteins(spark: SparkSession, path: str) -> LabeledGraph:
    """One or more files of the positional format, read in splits: a file of any size is parsed by many tasks.

    After the count and as many vertices, lines of one number only announce how many edges follow, so that a line's number in its file tells what it is.
    """
    text = F.trim("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("value"))
    lines = lines.filter((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).withColumn("at", F.monotonically_increasing_id())
    lines = materialised(lines)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each split
    placed = lines.join(F.broadcast(blocks), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), F.split("value", r"\s+").alias("p"))
    heads = placed.filter("line = 0").select("file", F.col("p")[0].cast("long").alias("n_vertices"))  # a row for each file
    rows = placed.filter("line > 0").join(F.broadcast(heads), "file")
    of_vertex = F.col("line") <= F.col("n_vertices")
    vertices = rows.filter(of_vertex).select(F.col("p")[0].try_cast("long").alias("id"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("label"))
    edges = rows.filter(~of_vertex & (F.size("p") > 1)).select(F.col("p")[0].try_cast("long").alias("src"), F.col("p")[1].try_cast("long").alias("dst"))  # filters may be tried after casts
    return LabeledGraph.of(vertices, edges)


def read_igraph(spark: SparkSession, path: str) -> LabeledGraph:
    """'v id label label ...' and 'e a b label' lines; several labels become one, joined by commas; other lines are left out."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    v = parts.filter(F.col("p")[0] == "v").select(F.col("p")[1].cast("long").alias("id"), F.array_join(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), ",").alias("label"))
    e = parts.filter(F.col("p")[0] == "e").select(F.col("p")[1].cast("long").alias("src"), F.col("p")[2].cast("long").alias("dst"))
    return LabeledGraph.of(v, e)


def read_graph(spark: SparkSession, path: str, fmt: str) -> LabeledGraph:
    if fmt == "proteins":
        return read_proteins(spark, path)
    if fmt == "igraph":
        return read_igraph(spark, path)
    if fmt == "parquet":
        return LabeledGraph.of(spark.read.parquet(posixpath.join(path, "vertices")), spark.read.parquet(posixpath.join(path, "edges")))
    raise ValueError(f"unknown graph format: {fmt}; known are {', '.join(FORMATS)}, parquet")


def read_pattern(spark: SparkSession, path: str, fmt: str) -> Pattern:
    """A small graph, brought to the driver."""
    g = read_graph(spark, path, fmt)
    return Pattern.of({r["id"]: r["label"] for r in g.vertices.collect()}, [(r["src"], r["dst"]) for r in g.edges.collect()])


def write_graph(graph: LabeledGraph, path: str) -> None:
    """As Parquet: vertices and edges."""
    graph.vertices.write.parquet(posixpath.join(path, "vertices"))
    graph.edges.write.parquet(posixpath.join(path, "edges"))


def graph_lines(graph: LabeledGraph) -> DataFrame:
    """place, value: the lines of the positional format, each edge from both ends; ``place`` orders them."""
    head = graph.vertices.agg(F.count("*").cast("string").alias("value")).select(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("nth")).alias("place"), "value")
    names = graph.vertices.select(F.struct(F.lit(1).alias("part"), F.col("id"), F.lit(0).cast("long").alias("nth")).alias("place"), F.concat_ws(" ", "id", "label").alias("value"))
    counts = graph.degrees().select(F.struct(F.lit(2).alias("part"), F.col("id"), F.lit(-1).cast("long").alias("nth")).alias("place"), F.col("deg").cast("string").alias("value"))
    ends = graph.adj.select(F.struct(F.lit(2).alias("part"), F.col("src").alias("id"), F.col("dst").alias("nth")).alias("place"), F.concat_ws(" ", "src", "dst").alias("value"))
    return head.unionByName(names).unionByName(counts).unionByName(ends)


def write_proteins(graph: LabeledGraph, path: str) -> None:
    """One ordered text file, for exchange of graphs that one task can write."""
    graph_lines(graph).coalesce(1).sortWithinPartitions("place").select("value").write.text(path)


def report_lines(query: str, target: str, matches: DataFrame, n_backtracking: int | None, n_matches: int, induced: bool) -> DataFrame:
    """place, value: the lines of a match report; matches: idx, mapping."""
    spark = matches.sparkSession
    kind = "Induced" if induced else "Non-induced"
    head = [f"Query Graph: {query}, Target Graph: {target}", f"Number Backtracking: {'' if n_backtracking is None else n_backtracking}", f"{kind} isomorphisms. Total number subgraph isomorphisms: {n_matches}"]
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "place long, value string")
    return first.unionByName(matches.select(F.col("idx").cast("long").alias("place"), F.concat(F.lit("Isomorphism "), F.col("idx").cast("string"), F.lit(": "), F.col("mapping")).alias("value")))


def write_report(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def parse_reports(texts: DataFrame) -> DataFrame:
    """query, target, induced, n_backtracking, n_matches, mappings from whole report texts (column value); a missing number is null."""
    find = lambda pattern, i=1: F.regexp_extract("value", pattern, i)
    number = lambda pattern: F.when(find(pattern) != "", find(pattern)).cast("long")
    return texts.select(
        find(r"(?i)query graph:\s*([^,\n]+)").alias("query"),
        find(r"(?i)target graph:\s*([^\n]+)").alias("target"),
        (find(r"(?im)^(non-induced|induced) isomorphisms") == "Induced").alias("induced"),
        number(r"(?i)number backtracking:\s*(\d+)").alias("n_backtracking"),
        number(r"(?i)total number subgraph isomorphisms:\s*(\d+)").alias("n_matches"),
        F.regexp_extract_all("value", F.lit(r"(?m)^Isomorphism \d+:\s*(\S+)"), 1).alias("mappings"),
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return parse_reports(spark.read.text(path, wholetext=True))


def short_names(reports: DataFrame) -> DataFrame:
    """reports with folders taken off query and target."""
    last = lambda c: F.element_at(F.split(c, r"[/\\]"), -1)
    return reports.withColumn("query", last("query")).withColumn("target", last("target"))


def write_itemsets(itemsets: DataFrame, path: str) -> None:
    itemsets.write.parquet(path)


def read_itemsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """value: an 'items appears in n vertex profiles:' line for each of itemsets (items, support) and, with a column ids, their list on a second line."""
    head = F.concat(F.lit("["), F.array_join("items", ", "), F.lit("] appears in "), F.col("support").cast("string"), F.lit(" vertex profiles:"))
    if "ids" not in itemsets.columns:
        return itemsets.select(head.alias("value"))
    return itemsets.select(F.concat(head, F.lit("\n["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("] \n")).alias("value"))


def parse_itemset_lines(lines: DataFrame) -> DataFrame:
    """items, support from single lines (column value); others are left out."""
    part = lambda i: F.regexp_extract("value", r"^\[(.*)\] appears in (\d+) vertex profiles", i)
    return lines.filter(part(2) != "").select(F.split(part(1), ", ").alias("items"), part(2).cast("long").alias("support"))


def parse_itemsets(texts: DataFrame) -> DataFrame:
    """items, support, ids from texts (column value) that hold itemsets with the lists of their vertices."""
    found = texts.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\[.*\] appears in \d+ vertex profiles:\s*\n\[.*\]"), 0)).alias("value"))
    part = lambda i: F.regexp_extract("value", r"^\[(.*)\] appears in (\d+) vertex profiles:\s*\n\[(.*)\]", i)
    ids = F.transform(F.filter(F.split(part(3), r",\s*"), lambda x: x != ""), lambda x: x.cast("long"))
    return found.select(F.split(part(1), ", ").alias("items"), part(2).cast("long").alias("support"), ids.alias("ids"))


#: Statuses of hard patterns and how the first line of a statistics file says them. Fixed values.
STATUS_LINES = {"hard": "Hard-to-find", "possibly hard": "Possibly Hard-to-find", "none": "No graphs of family"}
HARD = "size int, de int, di int, idx int, status string, estimate double, n_isomorphic int"


def hard_graph_rows(spark: SparkSession, found, size: int, degree: int, diameter: int, first: int = 0) -> DataFrame:
    """size, de, di, idx, status, estimate, n_isomorphic of found patterns (pattern, estimate, others, status), numbered from ``first``.

    Where nothing was found, one row of status 'none' tells that it was looked for.
    """
    rows = [(size, degree, diameter, first + i, status, float(value), others) for i, (_, value, others, status) in enumerate(found)]
    return spark.createDataFrame(rows or [(size, degree, diameter, None, "none", None, None)], HARD)


def next_index(hard: DataFrame, size: int, degree: int, diameter: int) -> int:
    """The number after the last one that a cell's patterns have; 0 where it has none."""
    last = hard.filter((F.col("size") == size) & (F.col("de") == degree) & (F.col("di") == diameter)).agg(F.max("idx").alias("last")).first()["last"]
    return 0 if last is None else last + 1


def parse_hard_stats(files: DataFrame) -> DataFrame:
    """size, de, di, idx, status, estimate, n_isomorphic from statistics texts (columns path, value).

    Sizes and ranges stand in the file's name (size_n_de_d_di_x_stats_i.txt; i may be absent), or in those of its folders (n/ded_dix/...). The first line tells the status; a
    missing number of isomorphic graphs counts as 0, as the word for none does. A file may hold several graphs; each has a row.
    """
    named = lambda i: F.regexp_extract("path", r"size_(\d+)_de_(\d+)_di_(\d+)_stats(?:_(\d+))?", i)
    folder = lambda i: F.regexp_extract("path", r"(\d+)[/\\\\]de(\d+)_di(\d+)[/\\\\]", i)
    number = lambda i: F.coalesce(*[F.when(x(i) != "", x(i)).cast("int") for x in (named, folder)])
    first = F.lower(F.trim(F.regexp_extract("value", r"^([^\n]*)", 1)))
    status = F.lit(None).cast("string")
    for name, line in STATUS_LINES.items():
        status = F.when(first == line.lower(), name).otherwise(status)
    graphs = F.regexp_extract_all("value", F.lit(r"(?im)^[^\n]*matchings:\s*[0-9.eE+-]+(?:[^\n]*\n)+?[^\n]*isomorphic graphs[^:\n]*:\s*\w+"), 0)
    rows = files.select(number(1).alias("size"), number(2).alias("de"), number(3).alias("di"), F.when(named(4) != "", named(4)).cast("int").alias("idx"), status.alias("status"), F.explode_outer(graphs).alias("graph"))
    value = F.regexp_extract("graph", r"(?i)matchings:\s*([0-9.eE+-]+)", 1).cast("double")
    others = F.coalesce(F.regexp_extract("graph", r"(?i)isomorphic graphs[^:\n]*:\s*(\d+)", 1).try_cast("int"), F.lit(0))
    rows = rows.filter(F.col("size").isNotNull() & F.col("status").isNotNull())
    return rows.select("size", "de", "di", "idx", "status", F.when(F.col("graph").isNotNull(), value).alias("estimate"), F.when(F.col("graph").isNotNull(), others).alias("n_isomorphic"))


def read_hard_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics files below a folder, at any depth."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return parse_hard_stats(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def hard_stats_text(status: str, estimate: float | None = None, n_isomorphic: int | None = None, induced: bool = True) -> str:
    """The text of a statistics file."""
    if status == "none":
        return STATUS_LINES[status] + "\n"
    return f"{STATUS_LINES[status]}\n\nEstimated Number {'Induce' if induced else 'Non-induce'} Matchings: {estimate}\nNumber of Isomorphic Graphs Found: {n_isomorphic}\n"
