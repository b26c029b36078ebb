"""What several corpus operators share: checkpoints, splits by document id, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spreads the edges of one vertex over this many join keys.
SALTS = 16
#: Edges that one task writes.
EDGES = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Without one there is no place for what outlives an executor, and that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no column is called so."""
    lower = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def _lowest_neighbour(edges: DataFrame, salts: int) -> DataFrame:
    """(src, low) for each src: its lowest neighbour or itself, repeated for each salt."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    low = low.select("src", F.least("low", "src").alias("low"))
    return low.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(salts)])))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of each vertex in ``edges`` (src, dst long): rows (node, component), component = lowest id reached.

    Alternates large-star and small-star, which turn every component into a star around its lowest
    vertex in a logarithmic number of rounds. Joins are salted, as a star's centre may have a
    third of all edges. Self-loops and repeated edges are harmless; no edges give no rows.
    """

    def salted(frame: DataFrame) -> DataFrame:
        return frame.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))

    # Edges are two numbers: so many of them make a task, whatever the number of shuffle partitions.
    tasks = max(8, -(-edges.count() // EDGES))
    current = materialize(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().coalesce(tasks))
    seen = None
    for _ in range(max_rounds):
        both = current.select("src", "dst").union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = salted(both).join(_lowest_neighbour(both, SALTS).hint("merge"), ["src", "salt"])
        large = large.filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        down = salted(large).join(_lowest_neighbour(large, SALTS).hint("merge"), ["src", "salt"])
        pairs = F.array(F.struct(F.col("src").alias("src"), F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))
        small = down.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").filter("src <> dst").distinct()
        current = materialize(small.coalesce(tasks))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.distinct())
