"""SpotSigs: chains of content words that follow common words, in DataFrame operations only.

A text's words are runs of letters and digits in lower case. A word is an anchor if it is a common word or has at most
two letters; the others are content words. Each content word directly after an anchor starts a chain of `CHAIN` content
words (fewer at the end of the text); the signature is a hash of the anchor and the chain. A text where no content word follows
an anchor has a chain at every word, so that it can be compared at all. The fingerprint is the set of signatures; the likeness of two
texts is the Jaccard similarity of their sets, 1 if both are empty.

Near classes join documents whose sets have a likeness of `threshold` or more, directly or through others. Equal sets
are compared once. Sets are partitioned by size: a pair at similarity t has sizes within the factor t of each other, so
each set meets its own size class and the next smaller one. There sets meet on a prefix of their signatures alone, those
that many sets share last in order: a pair at t has a signature of the larger one's first n - ceil(t n) + 1 among the
smaller one's first n - ceil(2 t n / (1 + t)) + 1. Every set of a bucket is compared with its most central one, the
head (the set whose buckets are largest); what can't reach t by size isn't compared at all. Then only pairs across components can change a class, and the
largest component of a bucket isn't joined with itself, so that a group of near copies costs a comparison a copy. As the
distance 1 - likeness is a metric, pairs whose distances to the head differ by more than 1 - t are left out, and so are
pairs that can't reach t even if they share all signatures that any other set of such a bucket has.

Null text counts as empty; an empty text has an empty set. Equal texts have equal fingerprints. Rows that repeat get
repeated results. An empty table gives no rows. Ids must be numbers (or null) where documents are set beside the next
one; other columns are kept by fingerprints() and not read by the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import fresh, materialize
from quillon.llm.neardup import components

CHAIN = 3
#: Common words of English, French, German and Spanish.
ANCHORS = sorted(set("the and was for that with are this have from not but had his her they she which you one all were there been their has would what will can said who more when its into them than der die das und den von mit sich des auf für ist dem nicht ein eine als auch werden aus hat dass nach wird bei einer les des est que une dans qui par pour sur pas plus avec son mais comme los las del que una por con para como más pero sus este".split()))
#: Documents of one range when each is set beside the next; ranges and quantile cells at most.
PER_RANGE, MOST_RANGES, CELLS = 1000, 100_000, 64
#: Parts that the hash of a text has inside an id, and bytes of text that a task takes.
WITHIN, TASK_BYTES = 10**9, 16 << 20
THRESHOLD = 0.8
#: Counters of signatures, and how many times their mean makes those of a counter common.
COUNTERS, COMMON = 1 << 16, 8


def fingerprints(df: DataFrame, column: str, out: str, chain: int = CHAIN) -> DataFrame:
    """`df` with `out`, the set of signatures of the text in `column`."""
    common = lambda w: (F.length(w) <= 2) | w.isin(ANCHORS)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at, of, got = (fresh(df, c) for c in ("_w", "_p", "_c"))
    df = df.withColumn(at, words)
    df = df.withColumn(of, F.filter(F.transform(at, lambda w, i: F.when(~common(w), i)), lambda i: i.isNotNull()))
    w, p = F.col(at), F.col(of)
    chained = F.transform(p, lambda i, j: F.when(i - F.coalesce(F.get(p, j - 1), F.lit(-1)) > 1, F.hash(F.get(w, i - 1), *[F.get(w, F.get(p, j + k)) for k in range(chain)])))
    plain = F.transform(w, lambda x, i: F.hash(*[F.get(w, i + k) for k in range(chain)]))
    df = df.withColumn(got, F.filter(chained, lambda x: x.isNotNull()))
    sets = F.sort_array(F.array_distinct(F.when(F.size(got) == 0, plain).otherwise(F.col(got))))
    return df.withColumn(out, sets).drop(at, of, got)


def shown(sets: Column) -> Column:
    return F.array_join(F.transform(sets, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def beside_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sets, next_text, next_sets: each document beside the next one by descending id, the last beside the first.

    Rows are dealt to ranges of about PER_RANGE rows by the id and, within an id, by a hash of the text (of equal width
    inside quantile cells), so that rows that repeat an id, or have none, spread out, too; neighbours meet inside a
    range. The first document of each range is also sent to the range above it. What is broadcast has a row a range,
    MOST_RANGES at most. Rows that repeat an id are ordered by that hash, then by text, largest first; null ids come last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = lambda x: x.cast("decimal(38,0)")
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_h"), F.octet_length(text).alias("_bytes"))
    rest = ids.agg(F.count(F.lit(1)), F.sum("_bytes"), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    total, tasks = rest[0], (rest[1] or 0) // TASK_BYTES + 1
    low, high = (rest[2] - 1) * WITHIN, (rest[3] + 1) * WITHIN
    ids = ids.withColumn("_key", whole(F.coalesce(F.col("doc_id"), F.lit(rest[2] - 1))) * F.lit(WITHIN) + F.pmod(F.col("_h"), F.lit(WITHIN))).select("_key")
    cells = ids.agg(F.percentile_approx(F.col("_key").cast("double"), [i / CELLS for i in range(1, CELLS)], 10_000)).first()[0]
    bounds = [low, *sorted({int(b) for b in cells or [] if low < b < high}), high]
    wide = [max(1, math.ceil((b - a) * (len(bounds) - 1) / min(MOST_RANGES, total // PER_RANGE + 1))) for a, b in zip(bounds, bounds[1:])]
    first = [0]
    for a, b, w in zip(bounds, bounds[1:], wide):
        first.append(first[-1] + (b - 1 - a) // w + 1)
    wholes = lambda xs: F.array(*[F.lit(str(x)).cast("decimal(38,0)") for x in xs])
    cell = F.size(F.filter(wholes(bounds[1:-1]), lambda b: b <= F.col("_key"))) if len(bounds) > 2 else F.lit(0)
    place = F.get(F.array(*map(F.lit, first[:-1])), F.col("_cell")) + F.floor((F.col("_key") - F.get(wholes(bounds[:-1]), F.col("_cell"))) / F.get(wholes(wide), F.col("_cell"))).cast("long")
    ranged = lambda x: x.withColumn("_cell", cell).withColumn("_range", place).drop("_cell")

    ends = ranged(ids).groupBy("_range").agg(F.max("_key").alias("_first"))
    up = Window.orderBy("_range")  # a row a range
    sent = ends.select(F.col("_first"), F.lead("_range").over(up).alias("_to"), F.min("_range").over(Window.partitionBy(F.lit(0))).alias("_lowest"))
    sent = sent.select("_first", F.coalesce("_to", "_lowest").alias("_to"))

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    texts = ranged(texts.withColumn("_key", whole(F.coalesce(F.col("doc_id"), F.lit(rest[2] - 1))) * F.lit(WITHIN) + F.pmod(F.xxhash64("text"), F.lit(WITHIN))))
    extra = texts.join(F.broadcast(sent), F.col("_key") == F.col("_first")).select("doc_id", "text", "_key", F.col("_to").alias("_range"), F.lit(1).alias("_sent"))
    both = fingerprints(texts.select("doc_id", "text", "_key", "_range", F.lit(0).alias("_sent")).unionByName(extra), "text", "sets")
    w = Window.partitionBy("_range").orderBy("_sent", F.desc("_key"), F.desc("text"))
    both = both.repartition(tasks, "_range")  # as many tasks as the input has need of
    return both.select("doc_id", "text", "sets", "_sent", F.lead("text").over(w).alias("next_text"), F.lead("sets").over(w).alias("next_sets")).filter("_sent = 0").drop("_sent")


def edited(text: Column, following: Column) -> Column:
    """The last third of `text` replaced by as many characters of `following`, or all of them."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def near_classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, near_class (the least id of the class), a row per row. Sets are known by a 64-bit hash."""
    said = fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "sets")
    docs = materialize(said.select("doc_id", "sets", F.xxhash64("sets").alias("s")), "spots")
    classes = materialize(docs.groupBy("s").agg(F.min("doc_id").alias("id"), F.first("sets").alias("sets")), "classes")
    counter = lambda x: F.pmod(x, F.lit(COUNTERS))
    counts = classes.select(F.explode("sets").alias("x")).groupBy(counter(F.col("x")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["k"]: r["n"] for r in counts.collect()}  # COUNTERS rows at most
    common = [k for k, n in counts.items() if n > COMMON * max(1.0, sum(counts.values()) / COUNTERS)]
    ordered = F.sort_array(F.transform("sets", lambda x: F.struct(counter(x).isin(common).alias("common"), x.alias("x")))) if common else F.transform("sets", lambda x: F.struct(F.lit(False).alias("common"), x.alias("x")))
    n = F.col("n")
    least = lambda share: (n - F.ceil(n * share - 1e-9) + 1).cast("int")
    heads = classes.filter(F.size("sets") > 0).select("s", F.size("sets").alias("n"), ordered.alias("o"))
    spots = heads.select("s", "n", F.posexplode(F.slice("o", 1, least(threshold))).alias("pos", "o")).select("s", "n", F.col("o.x").alias("x"), (F.col("pos") < least(2 * threshold / (1 + threshold))).alias("short"))
    several = spots.groupBy("x").agg(F.count(F.lit(1)).alias("_n"), F.max("short").alias("_short")).filter("_n > 1 and _short").select(F.col("x").alias("_x"))
    met = materialize(spots.join(several.hint("merge"), F.col("x") == F.col("_x"), "left_semi"), "met")
    part = F.floor(F.log(n.cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    members = met.withColumn("part", part).select(F.explode(F.array(F.struct("part", F.lit(0).alias("down")), F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("down")))).alias("p"), "s", "n", "x", "short")
    members = members.select(F.struct("p.part", "x").alias("path"), "s", "n", (F.col("short") & (F.col("p.down") == 0)).alias("short"))
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9

    buckets = members.groupBy("path").agg(F.max("short").alias("any"), F.count(F.lit(1)).alias("k")).filter("any and k > 1").select(F.col("path").alias("_path"), "k")
    members = materialize(members.join(buckets, F.col("path") == F.col("_path")).drop("_path"), "members")
    central = members.groupBy(F.col("s").alias("_s")).agg(F.sum("k").alias("central"))  # of near copies the least edited one
    chosen = members.join(central, F.col("s") == F.col("_s")).groupBy(F.col("path").alias("_path")).agg(F.max(F.struct("central", "s", "n")).alias("head"))
    members = materialize(members.join(chosen, F.col("path") == F.col("_path")).select("path", "s", "n", "short", "head"), "members")
    wanted = members.select(F.col("s").alias("_s")).distinct()
    sets = materialize(classes.join(wanted.hint("merge"), F.col("s") == F.col("_s"), "left_semi").select("s", "sets"), "wanted")

    def compared(pairs: DataFrame) -> DataFrame:
        of = lambda c: sets.select(F.col("s").alias(c), F.col("sets").alias(f"_{c}"))
        return materialize(pairs.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness(F.col("_a"), F.col("_b")).alias("likeness")), "compared")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = compared(members.filter((F.col("s") != F.col("head.s")) & fits(n, F.col("head.n"))).select(*pair(F.col("s"), F.col("head.s"))))
    links = first.filter(F.col("likeness") >= threshold - 1e-9).select("a", "b")
    found = components(links)

    far = members.withColumns({"_a": F.least("s", "head.s"), "_b": F.greatest("s", "head.s")}).join(first, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left")
    far = far.select("path", "s", "n", "short", F.when(F.col("s") == F.col("head.s"), 1.0).otherwise(F.col("likeness")).alias("near"))
    far = far.join(found, F.col("s") == F.col("node"), "left").select("path", "s", "n", "short", "near", F.coalesce("component", "s").alias("component"))
    parts = far.groupBy("path", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy(F.col("path").alias("_path")).agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "component"))["component"].alias("main")).filter("parts > 1")
    level = materialize(far.join(mixed, F.col("path") == F.col("_path")).select("path", "s", "n", "short", "near", "component", (F.col("component") != F.col("main")).alias("minor")), "mixed")
    held = sets.join(level.select(F.col("s").alias("_s")).distinct().hint("merge"), F.col("s") == F.col("_s"), "left_semi").select("s", F.explode("sets").alias("x"))
    own = held.groupBy("x").agg(F.count(F.lit(1)).alias("k"), F.min("s").alias("_of")).filter("k = 1").groupBy("_of").agg(F.count(F.lit(1)).alias("own"))
    level = level.join(own, F.col("s") == F.col("_of"), "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("_of", "own")
    level = materialize(level.filter(F.col("common") >= F.col("n") * threshold - 1e-9), "level")
    right = level.filter("short").select("path", *[F.col(c).alias(f"_{c}") for c in ("s", "n", "near", "component", "minor", "common")])
    after = (n > F.col("_n")) | (n == F.col("_n")) & (F.col("s") > F.col("_s")) | ~F.col("short")  # pairs of two short ones once
    across = (F.col("component") != F.col("_component")) & (n >= F.col("_n")) & after & fits(n, F.col("_n")) & F.coalesce(F.abs(F.col("near") - F.col("_near")) <= 1 - threshold + 1e-9, F.lit(True))
    both = F.least("common", "_common")
    across &= both >= threshold * (n + F.col("_n") - both) - 1e-9
    formed = level.filter("minor").join(right, "path").filter(across).unionByName(level.filter("not minor").join(right.filter("_minor"), "path").filter(across))
    more = compared(formed.select(*pair(F.col("s"), F.col("_s"))))
    links = links.unionByName(more.filter(F.col("likeness") >= threshold - 1e-9).select("a", "b"))
    found = components(links)
    named = classes.select(F.col("s").alias("_s"), "id").join(found, F.col("_s") == F.col("node"), "left").select("_s", "id", F.coalesce("component", "_s").alias("component"))
    least_id = named.groupBy(F.col("component").alias("_component")).agg(F.min("id").alias("near_class"))
    named = materialize(named.join(least_id, F.col("component") == F.col("_component")).select("_s", "near_class"), "named")
    return docs.join(named, F.col("s") == F.col("_s")).select("doc_id", "near_class")
