"""Shards of near equal bytes by a k-d tree over metadata, in DataFrame operations only.

The tree's nodes are split at the weighted median (by bytes) of the node's widest dimension, until leaves have the
target size. Dimensions are mapped to [0, 2^20) in order, languages and sources by their rank among the distinct values;
a row's key in a dimension is that level followed by a hash of the text and one of the id, so that equal texts lie side
by side among equal levels and ties can be split anywhere. A median is found by
histograms of a fixed number of bins per node, refined until the bin holding it is negligible; only these bins reach the
driver.

Law `bytes`: leaves differ by little more than the largest documents. Groups (equal texts) are not kept together where
their language, source or id falls on different sides of a median. Null text has size 1; null metadata is the lowest value,
and so is an id that isn't a number (doc_id may be of any type). Repeated rows lie in the same shard. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, number_within

SHARDS, LEVELS, BINS = 16, 20, 1024
#: Rows of one numbering task; share of a node's bytes that its median may be off.
PER_CHUNK, SLACK = 100_000, 1e-4


def narrow(df: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, th (hash of the text) and the metadata of each document."""
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"), F.length(text).alias("n"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def level(x: Column, low: float, high: float) -> Column:
    """Order-preserving map to [0, 2^LEVELS)."""
    top = (1 << LEVELS) - 1
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor((x - F.lit(low)) * F.lit(top / max(high - low, 1e-9))).cast("long")))


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """`df` with `out`: the rank of `column` among its distinct values, from 1 on; 0 for null.

    The distinct values are sorted by range, and each range is numbered by itself. Whether they are few enough to be
    broadcast is for Spark to see from their measured size; if not, hot values are split by the skew join.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    values = materialize(values.repartitionByRange("_value").withColumn("_part", F.spark_partition_id()), "values")
    counts = values.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = values.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy("_value")))
    ranks = materialize(own.join(shifts, F.col("_part") == F.col("_of")).select("_value", (F.col("_row") + F.col("_shift")).cast("double").alias("_rank")), "ranks")
    return df.join(ranks, F.col(column) == F.col("_value"), "left").withColumn(out, F.coalesce("_rank", F.lit(0.0))).drop("_value", "_rank")


def coded(df: DataFrame) -> DataFrame:
    """The dimensions as keys: k0 length (logarithmic), k1 language, k2 source, k3 doc_id."""
    raw = ranked(ranked(df, "lang", "d1"), "source", "d2")
    raw = raw.select("doc_id", "size", "text_crc32", "th", F.log2(F.col("n") + 1.0).alias("d0"), "d1", "d2", F.coalesce(F.col("doc_id").try_cast("double"), F.lit(-1.0)).alias("d3"))
    ends = raw.agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tail = F.pmod(F.col("th"), F.lit(1 << 16)) * (1 << 16) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16))
    return raw.select("doc_id", "size", "text_crc32", "th", *[(level(F.col(f"d{i}"), ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0) * (1 << 32) + tail).alias(f"k{i}") for i in range(4)])


def medians(rows: DataFrame, nodes: dict[int, tuple[int, int, int, int]], share: dict[int, float]) -> dict[int, int]:
    """node -> least key of its right half; nodes: node -> (dimension, lowest key, highest key, bytes)."""
    span = {n: (lo, hi + 1, 0) for n, (_, lo, hi, _) in nodes.items()}  # half-open, and the bytes below it
    done: dict[int, int] = {}
    while open_ := {n: s for n, s in span.items() if n not in done}:
        width = {n: max(1, -(-(hi - lo) // BINS)) for n, (lo, hi, _) in open_.items()}
        cell = F.lit(None).cast("struct<node:int,bin:bigint>")
        for n, (lo, hi, _) in open_.items():
            key = F.col(f"k{nodes[n][0]}")
            cell = F.when((F.col("node") == n) & (key >= lo) & (key < hi), F.struct(F.lit(n).alias("node"), F.floor((key - lo) / F.lit(width[n])).cast("long").alias("bin"))).otherwise(cell)
        got: dict[int, list] = {n: [] for n in open_}
        for r in rows.select(cell.alias("c"), "size").filter("c is not null").groupBy("c").agg(F.sum("size").alias("s")).collect():  # BINS rows a node at most
            got[r["c"]["node"]].append((r["c"]["bin"], r["s"]))
        for n, (lo, hi, below) in open_.items():
            want, total = nodes[n][3] * share[n], below
            for b, s in sorted(got[n]):
                if total + s >= want:
                    a = lo + b * width[n]
                    if width[n] == 1 or s <= SLACK * nodes[n][3]:
                        done[n] = a + width[n] if total + s - want <= want - total else a
                    else:
                        span[n] = (a, a + width[n], total)
                    break
                total += s
            else:
                done[n] = hi
    return done


def shards(df: DataFrame, leaves: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = materialize(coded(materialize(narrow(df), "metadata")), "keys")
    tree = rows.withColumn("node", F.lit(0))
    parts = {0: leaves}
    while any(p > 1 for p in parts.values()):
        stats = tree.groupBy("node").agg(F.sum("size").alias("s"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("lo", F.min), ("hi", F.max))]).collect()  # a row a node
        nodes, share = {}, {}
        for r in stats:
            if parts[r["node"]] > 1:
                d = max(range(4), key=lambda i: (r[f"hi{i}"] >> 32) - (r[f"lo{i}"] >> 32))
                nodes[r["node"]] = (d, r[f"lo{d}"], r[f"hi{d}"], r["s"])
                share[r["node"]] = (parts[r["node"]] + 1) // 2 / parts[r["node"]]
        cuts = medians(tree, nodes, share) if nodes else {}
        step, after = F.lit(None).cast("int"), {}
        for n, p in parts.items():
            left, right = 2 * n + 1, 2 * n + 2
            if p > 1:
                after |= {left: (p + 1) // 2, right: p // 2}
                side = F.col(f"k{nodes[n][0]}") >= cuts[n] if n in nodes else F.lit(False)
                step = F.when(F.col("node") == n, F.when(side, F.lit(right)).otherwise(F.lit(left))).otherwise(step)
            else:
                after[n] = 1
                step = F.when(F.col("node") == n, F.lit(n)).otherwise(step)
        parts = after
        tree = materialize(tree.withColumn("node", step), "tree")
    number = F.lit(None).cast("int")
    for i, n in enumerate(sorted(parts)):
        number = F.when(F.col("node") == n, F.lit(i)).otherwise(number)
    placed = tree.select("doc_id", "size", "text_crc32", "th", number.alias("shard"))
    out = number_within(placed, ["shard"], [F.col("th"), F.col("doc_id")], F.xxhash64("doc_id", "th"), PER_CHUNK, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
