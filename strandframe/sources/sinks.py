"""Line formats and writers.  Every writer is a distributed text write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequences as S

FILL_COLOURS = ("lightblue", "palegreen", "khaki", "thistle", "gold")


def write_lines(df: DataFrame, path: str, column: str = "value", order: list[str] | None = None) -> None:
    """Write one text column; with ``order`` the part files follow each other in that order."""
    lines = df.orderBy(*order) if order else df
    lines.select(column).write.text(path)


def fasta_lines(reads: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return reads.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def wrapped(seq, width: int = 60) -> Column:
    """Sequence broken into lines of ``width`` bases, without a final line break."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")


def contig_name(number, length, coverage=None, ident=None) -> Column:
    """``NODE_n_length_l[_cov_c][_ID_i]``."""
    parts = [F.lit("NODE_"), number.cast("string"), F.lit("_length_"), length.cast("string")]
    if coverage is not None:
        parts += [F.lit("_cov_"), coverage.cast("string")]
    if ident is not None:
        parts += [F.lit("_ID_"), ident.cast("string")]
    return F.concat(*parts)


def wrapped_fasta_lines(contigs: DataFrame, number: str = "number", seq: str = "seq") -> DataFrame:
    name = contig_name(F.col(number), F.length(seq))
    return contigs.select(F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq)).alias("value"))


def fastq_lines(reads: DataFrame, flip: Column | None = None) -> DataFrame:
    """FASTQ records; where ``flip`` holds, the read is written as its reverse complement."""
    turned = F.lit(False) if flip is None else flip
    seq = F.when(turned, S.reverse_complement("seq")).otherwise(F.col("seq"))
    quality = F.when(turned, F.reverse("quality")).otherwise(F.col("quality"))
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), seq, F.lit("\n+\n"), quality).alias("value"))


def fastq_to_fasta(fastq: DataFrame) -> DataFrame:
    return fasta_lines(fastq)


def cluster_map_lines(rcm: DataFrame, name: str = "read_name") -> DataFrame:
    return rcm.select(F.concat_ws("\t", F.col(name).cast("string"), F.col("cluster_id").cast("string")).alias("value"))


def cluster_fasta_lines(clusters: DataFrame) -> DataFrame:
    """FASTA records with ``cluster___id___size___n`` names, one two-line value each."""
    header = F.concat(F.lit(">cluster___"), F.col("cluster_id"), F.lit("___size___"), F.col("size"))
    return clusters.select(F.concat(header, F.lit("\n"), F.col("seq")).alias("value"))


def neighbour_lines(scored: DataFrame) -> DataFrame:
    """``rep.cluster - rep.cluster (score = s)`` per scored pair."""
    return scored.select(F.format_string("%d.%d - %d.%d (score = %d)", "rep_a", "a_id", "rep_b", "b_id", "score").alias("line"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """``metric<TAB>value`` rows."""
    return metrics.select(F.concat_ws("\t", "metric", F.col("value").cast("string")).alias("line"))


def metric_pivot(metrics: DataFrame, files: list[str]) -> DataFrame:
    """One column per result file, ``-`` where a file lacks the metric."""
    wide = metrics.groupBy("metric").pivot("file", files).agg(F.first("value"))
    return wide.select("metric", *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("-")).alias(f) for f in files])


def metis_lines(vertices: DataFrame, edges: DataFrame, weighted_vertices: bool = False) -> DataFrame:
    """``place, value`` lines of a METIS graph with edge weights.

    ``vertices`` has a dense 0-based ``v`` and, on request, ``weight``; ``edges`` lists both
    directions as ``src, dst, weight``.  Self-loops are left out and ids are 1-based.
    Line 0 is the header.
    """
    proper = edges.where("src <> dst")
    # the format puts all neighbours of a vertex on one line
    joined = proper.groupBy("src").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("dst", "weight"))), lambda x: F.concat_ws(" ", x["dst"] + 1, x["weight"])), " ").alias("_l"))
    own = [F.col("weight").cast("string")] if weighted_vertices else []
    body = vertices.withColumnRenamed("v", "src").join(joined, "src", "left").select(
        (F.col("src") + 1).alias("place"), F.concat_ws(" ", *own, F.col("_l")).alias("value"))
    counts = vertices.agg(F.count("*").alias("nv")).join(F.broadcast(proper.agg(F.expr("count(*) div 2").alias("ne"))))
    kind = "011" if weighted_vertices else "001"
    return counts.select(F.lit(0).cast("long").alias("place"), F.concat_ws(" ", "nv", "ne", F.lit(kind)).alias("value")).unionByName(
        body.withColumn("place", F.col("place").cast("long")))


def dot_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``place, value`` lines of a Graphviz drawing of repertoire connections.

    ``vertices``: ``rep_id, cluster_id, size``; ``edges``: ``rep_a, a_id, rep_b, b_id, shared, kind``.
    """
    colour = F.element_at(F.array(*[F.lit(c) for c in FILL_COLOURS]), F.col("rep_id") % len(FILL_COLOURS) + 1)
    v = vertices.select(F.lit(1).alias("place"), F.format_string(
        '"%d.%d" [label="%d\\nsize %d" fillcolor=%s style=filled]', "rep_id", "cluster_id", "cluster_id", "size", colour).alias("value"))
    far = F.col("kind") == "distant"
    e = edges.select(F.lit(2).alias("place"), F.format_string(
        '"%d.%d" -> "%d.%d" [label=%d style=%s color=%s%s]', "rep_a", "a_id", "rep_b", "b_id", "shared",
        F.when(far, "solid").otherwise("bold"), F.when(far, "black").otherwise("red"),
        F.when(F.col("kind") == "close", "").otherwise(" dir=none")).alias("value"))
    frame = vertices.sparkSession.createDataFrame([(0, "digraph g {"), (0, "labeldistance=1"), (3, "}")], "place int, value string")
    return frame.unionByName(v).unionByName(e)


def histogram_lines(hist: DataFrame) -> DataFrame:
    return hist.select(F.concat_ws(" ", F.col("value").cast("string"), F.col("n").cast("string")).alias("line"))


def plot_bins(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, low, high, n``: data of a histogram plot with equal bins.

    Bounds that are not given are those of the data, so that no value is left out.
    """
    given = lambda bound, found: (found if bound is None else F.max(F.lit(float(bound))))
    span = df.agg(given(low, F.min(value)).cast("double").alias("_low"), given(high, F.max(value)).cast("double").alias("_high"))  # one row
    span = span.withColumn("_width", (F.col("_high") - F.col("_low")) / bins)
    inside = df.select(F.col(value).alias("_v")).join(F.broadcast(span)).where("_v BETWEEN _low AND _high")
    place = F.when(F.col("_width") > 0, F.least(F.floor(F.try_divide(F.col("_v") - F.col("_low"), F.col("_width"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return inside.groupBy(place.cast("long").alias("bin"), "_low", "_width").agg(F.count("*").alias("n")).select(
        "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"), (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("high"), "n")
