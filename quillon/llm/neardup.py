"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five consecutive words (runs of letters and digits in lower case), known by a 64-bit hash; a text of one to
four words is one shingle. Its weight is its count in the text times its damped inverse document frequency. Document
frequencies are counted over all documents in a table of `BUCKETS` counters by hash of the shingle; the mean load of a
counter is taken off, so what is rarer than the table resolves counts as occurring once. The table has the same size
whatever the input, and as both load and frequencies grow with the corpus, the weights don't change with its size.

Each distinct text is sampled `BANDS * ROWS` times by improved consistent weighted sampling (Ioffe 2010): for a shingle
of weight w, with r and c from Gamma(2, 1) and beta uniform by its hash, t = floor(ln w / r + beta), y = exp(r (t -
beta)), a = c / (y exp(r)); the sample is (shingle, t) with the least a. Two texts agree in a sample with the
probability of their weighted Jaccard similarity. A band is a hash of ROWS samples; candidates are texts that share
LEAST_BANDS bands or more (at a similarity of 0.8 all but about two in 10,000 do).

Candidates are verified by their exact weighted Jaccard similarity (from `threshold` on they are linked); classes are
the connected components. In a first round every text of a band's bucket meets the bucket's most central text (the one
whose buckets are largest: in a group of near copies the least edited). Then only pairs across components can change a
class, and the largest component of a bucket is never joined with itself: a bucket of copies with one stranger costs a
pair a copy. Buckets where the pairs across are at most PARTNERS a text form them. For the texts of the other buckets
(edited copies by the thousands, or documents that share a passage and nothing else) the weight of shingles that no
other of these texts has is counted exactly; it bounds the similarity of any of their pairs, as do the distances of both
to the central text, and only pairs that the bounds allow are verified. So a bucket of copies of any size takes linear
work but for texts that might be linked and aren't yet, and no bucket is cut off.

Equal texts are one text from the start. Null text counts as empty; texts without words are only equal to themselves.
Texts are told apart by their hashes, never by an id alone. Rows that repeat an id belong to one document, which joins
the classes of all its texts; spare() judges each text of such an id by itself. Rows with a null id are left out. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, materialize

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 3
#: Bands that candidates share; pairs a text that a bucket may form without looking for unique shingles.
LEAST_BANDS, PARTNERS = 2, 16
#: Counters of document frequency; counters of one row when tables are summed; summing tasks.
BUCKETS, BLOCK, SUM_TASKS = 1 << 20, 1 << 14, 16
#: Share of the documents from which on down a shingle is rare, and how much more it then weighs than one in all of them.
#: Undamped, a text's edits would outweigh what it shares with thousands of its near copies, and hide the likeness.
RARE, DAMPING = 1e-4, 0.25
#: Random values are read from tables of this many entries by two parts of a mixed hash.
DRAWS = 1 << 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """array<long>: a hash for each word."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray) -> np.ndarray:
    """uint64 hashes of the runs of SHINGLE words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(SHINGLE, n)
    h = words[: n - k + 1].copy()
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[j : n - k + 1 + j]
    return (h ^ (h >> np.uint64(32))) * MIX


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The uint64 arrays of an array<long> column."""
    flat, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(at, at[1:]))


def frequencies(words: DataFrame) -> np.ndarray:
    """int64[BUCKETS]: how many documents have a shingle in the bucket (counted once for each shingle)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            got = [np.unique(shingles(w)) for w in lists(batch.column(0))]
            if got:
                table += np.bincount(bucket(np.concatenate(got)), minlength=BUCKETS)
        for a in range(0, BUCKETS, BLOCK):
            if (part := table[a : a + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK], pa.int32()), pa.array([part.astype(np.int32)], pa.list_(pa.int32()))], ["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # as many blocks as this task is dealt, whatever the number of rows
        for batch in batches:
            flat, at = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for block, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                sums.setdefault(block, np.zeros(BLOCK, np.int64))
                sums[block] += flat[a:b]
        for block, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n], pa.list_(pa.int64()))], ["block", "n"])

    table = np.zeros(BUCKETS, np.int64)
    counted = words.mapInArrow(count, "block int, n array<int>").repartition(SUM_TASKS, "block").mapInArrow(add, "block int, n array<long>")
    for r in counted.toLocalIterator():  # BUCKETS / BLOCK rows
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.array(r["n"])
    return table


def idf(table: np.ndarray, documents: int) -> np.ndarray:
    """float32[BUCKETS]: damped inverse document frequency of the shingles in each bucket, 1 to 1 + DAMPING."""
    own = np.maximum(1.0, table - np.median(table)) if table.any() else np.ones(len(table))
    rarity = np.log(np.maximum(1.0, documents / np.maximum(own, max(1.0, documents * RARE)))) / -np.log(RARE)
    return (1.0 + DAMPING * rarity).astype(np.float32)


def weighted(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, their TF-IDF weights)."""
    h, n = np.unique(shingles(words), return_counts=True)
    return h, n * weights[bucket(h)]


def draws(seed: int = 5) -> tuple[np.ndarray, ...]:
    """Tables of r, 1 / r, beta and ln c, and an odd multiplier for each sample."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2.0, 1.0, DRAWS).astype(np.float32)
    return r, 1 / r, rng.random(DRAWS, np.float32), np.log(rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32), rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def samples(h: np.ndarray, w: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """uint64[BANDS * ROWS]: consistent samples (shingle, t) of a weighted set that isn't empty."""
    r, inverse, beta, log_c, multipliers = tables
    log_w, best, key = np.log(w).astype(np.float32), None, None
    every = np.arange(len(multipliers))
    for a in range(0, len(h), 4096):
        part, lw = h[a : a + 4096], log_w[a : a + 4096]
        mixed = (part ^ (part >> np.uint64(31)))[None, :] * multipliers[:, None]
        i, j = (mixed >> np.uint64(52)).astype(np.int32), ((mixed >> np.uint64(40)) & np.uint64(DRAWS - 1)).astype(np.int32)
        b = beta[i]
        t = np.floor(lw * inverse[i] + b)
        score = log_c[j] - r[i] * (t - b + 1)
        at = score.argmin(1)
        low = score[every, at]
        got = part[at] * np.uint64(31) + t[every, at].astype(np.int64).astype(np.uint64)
        if best is None:
            best, key = low, got
        else:
            better = low < best
            best, key = np.where(better, low, best), np.where(better, got, key)
    return key


def bands(key: np.ndarray) -> np.ndarray:
    """int64[BANDS]."""
    k = key.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for j in range(ROWS):
        h = (h ^ k[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two arrays of word hashes."""
    (ha, wa), (hb, wb) = weighted(a, weights), weighted(b, weights)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
    return float(both / max(1e-12, wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both))


def signed(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, h1, h2 (hashes of the whole text), total (weight), bands array<long> (empty without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = draws()
        for batch in batches:
            total, keys = [], []
            for words in lists(batch.column("words")):
                h, w = weighted(words, weights)
                total.append(float(w.sum(dtype=np.float64)))
                keys.append(bands(samples(h, w, tables)) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(total, pa.float64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "total", "bands"])

    return docs.select("doc_id", "h1", "h2", word_hashes(F.col("text")).alias("words")).mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, total double, bands array<long>")


def linked(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) of a similarity of `threshold` or more, with it; texts: rep, text."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([similarity(x, y, weights) for x, y in zip(lists(batch.column(2)), lists(batch.column(3)))], np.float64)
            keep = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(s).filter(keep)], ["a", "b", "similarity"])

    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", word_hashes(F.col("_a")), word_hashes(F.col("_b"))).mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def unique_weight(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """rep, own: the weight of the shingles that no other of these texts has."""
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, words in enumerate(lists(batch.column(1))):
                h, w = weighted(words, weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), k))), pa.array(h.view(np.int64)), pa.array(w.astype(np.float64))], ["rep", "s", "w"])

    said = texts.select("rep", word_hashes(F.col("text"))).mapInArrow(run, f"rep {kind}, s long, w double")
    own = said.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep"), F.min("w").alias("w")).filter("n = 1")
    return own.groupBy("rep").agg(F.sum("w").alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of the edges (a, b): least labels spread, and labels of labels."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        near = now.join(seen, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        of = now.select(F.col("node").alias("n"), F.col("component").alias("further"))
        after = materialize(near.join(of, F.col("new") == F.col("n"), "left").select("node", "old", F.least("new", "further").alias("component")), "labels")
        if not after.filter("old <> component").limit(1).count():
            return after.select("node", "component")
        now = after.select("node", "component")


def text_classes(df: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), component (struct<id, h1, h2>: the least text of its class, by its least id), n_spanning_links; a row per row."""
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    n = docs.count()
    weights = idf(frequencies(docs.select(word_hashes(F.col("text")).alias("words"))), n)
    table = materialize(signed(docs, weights), "signatures")
    reps = materialize(table.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("total").alias("total"), F.first("bands").alias("bands")).select(F.struct("id", "h1", "h2").alias("rep"), "total", "bands"), "texts")

    keyed = reps.select("rep", "total", "bands", F.explode("bands").alias("path"))
    sizes = keyed.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("path", "_path")
    shared = materialize(keyed.join(sizes, F.col("path") == F.col("_path")).select("path", "rep", "total", "bands", "_n"), "shared")
    central = shared.groupBy(F.col("rep").alias("_rep")).agg(F.sum("_n").alias("central"))
    ranked = shared.join(central, F.col("rep") == F.col("_rep")).select("path", "rep", "total", "bands", "central")
    heads = ranked.groupBy(F.col("path").alias("_path")).agg(F.min(F.struct((-F.col("central")).alias("central"), "rep", "total", "bands")).alias("head"))
    members = materialize(shared.join(heads, F.col("path") == F.col("_path")).select("path", "rep", "total", "bands", "head"), "members")
    may = lambda x, y, p, q: (F.least(x, y) >= (threshold - 1e-9) * F.greatest(x, y)) & (F.size(F.array_intersect(p, q)) >= LEAST_BANDS)
    first = members.filter((F.col("rep") != F.col("head.rep")) & may(F.col("total"), F.col("head.total"), F.col("bands"), F.col("head.bands")))
    first = materialize(first.select(F.least("head.rep", "rep").alias("a"), F.greatest("head.rep", "rep").alias("b")).distinct(), "pairs")

    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    of_rep = materialize(reps.join(wanted, F.col("rep") == F.col("_rep"), "left_semi").select("rep", F.col("rep.id").alias("_id"), F.col("rep.h1").alias("_h1"), F.col("rep.h2").alias("_h2")), "wanted")
    met = docs.join(of_rep.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    texts = materialize(met.select("rep", "text").dropDuplicates(["rep"]), "candidates")
    judged = materialize(linked(first, texts, weights, 0.0), "links")
    links = judged.filter(F.col("similarity") >= threshold)
    found = components(links)

    known = judged.withColumnRenamed("similarity", "_similarity")
    to_head = members.withColumns({"_x": F.least("head.rep", "rep"), "_y": F.greatest("head.rep", "rep")}).join(known, (F.col("_x") == F.col("a")) & (F.col("_y") == F.col("b")), "left")
    to_head = to_head.select("path", "rep", "total", "bands", F.when(F.col("rep") == F.col("head.rep"), 1.0).otherwise(F.col("_similarity")).alias("near"))
    named = to_head.join(found, F.col("rep") == F.col("node"), "left").select("path", "rep", "total", "bands", "near", F.coalesce("component", "rep").alias("component"))
    parts = named.groupBy("path", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(F.col("path").alias("_path")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component"))["component"].alias("main")).filter("parts > 1")
    mixed = mixed.select("_path", "main", (F.col("n") * F.col("n") - F.col("squares") > 2 * PARTNERS * F.col("n")).alias("heavy"))
    level = materialize(named.join(mixed, F.col("path") == F.col("_path")).drop("_path"), "mixed")
    alone = materialize(unique_weight(texts.join(level.filter("heavy").select(F.col("rep").alias("_rep")).distinct(), F.col("rep") == F.col("_rep"), "left_semi"), weights), "unique")
    level = level.join(alone.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep"), "left").select("path", "rep", "total", "bands", "near", "component", (F.col("component") != F.col("main")).alias("minor"), F.when(F.col("heavy"), F.coalesce("own", F.lit(0.0))).otherwise(0.0).alias("own"))
    left = level.filter(F.col("total") - F.col("own") >= (threshold - 1e-6) * F.col("total")).withColumnRenamed("rep", "a")
    right = left.select("path", F.col("a").alias("b"), F.col("total").alias("_total"), F.col("bands").alias("_bands"), F.col("near").alias("_near"), F.col("component").alias("_component"), F.col("own").alias("_own"), F.col("minor").alias("_minor"))
    both = F.least(F.col("total") - F.col("own"), F.col("_total") - F.col("_own"))
    bound = both >= (threshold - 1e-6) * (F.col("total") + F.col("_total") - both)
    bound &= F.coalesce(F.abs(F.col("near") - F.col("_near")) <= 1 - threshold + 1e-6, F.lit(True))  # the distance 1 - J is a metric
    once = F.get(F.array_intersect("bands", "_bands"), F.lit(0)) == F.col("path")  # in the first bucket that both are in
    # The bucket's largest component never meets itself, so the join forms at most four pairs for each one across components.
    across = left.filter("minor").join(right, "path").filter((~F.col("_minor") | (F.col("a") < F.col("b"))) & (F.col("component") != F.col("_component")) & bound & may(F.col("total"), F.col("_total"), F.col("bands"), F.col("_bands")) & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = across.distinct().join(first.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
    more = materialize(linked(across, texts, weights, threshold), "links")
    every = links.select("a", "b").union(more.select("a", "b"))
    if more.limit(1).count():
        found = components(every)

    degree = every.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n_spanning_links"))
    done = reps.select("rep").join(found, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("r"), "left")
    done = done.select(F.col("rep.h1").alias("_h1"), F.col("rep.h2").alias("_h2"), F.coalesce("component", "rep").alias("component"), F.coalesce("n_spanning_links", F.lit(0)).cast("long").alias("n_spanning_links"))
    return table.select("doc_id", "h1", "h2").join(done, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("doc_id", "h1", "h2", "component", "n_spanning_links")


def classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of the class), n_spanning_links (the links of its text that were verified, enough to span the class and not all), a row per document."""
    rows = materialize(text_classes(df, threshold, id_col, text_col), "classes")
    ids = rows.groupBy("doc_id").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("n_spanning_links").alias("n_spanning_links"))
    several = materialize(ids.filter("least <> most").select(F.col("doc_id").alias("_id"), "least"), "several")
    if not several.limit(1).count():
        return ids.select("doc_id", F.col("least.id").alias("class_id"), "n_spanning_links")
    joined = components(rows.join(several, F.col("doc_id") == F.col("_id")).filter("component <> least").select(F.col("least").alias("a"), F.col("component").alias("b")))
    ids = ids.withColumnRenamed("least", "of").join(joined, F.col("of") == F.col("node"), "left")
    return ids.select("doc_id", F.coalesce("component", "of")["id"].alias("class_id"), "n_spanning_links")


def spare(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (first hash of the text): the rows whose class of texts has another one that stays, the least by its least id."""
    rows = text_classes(df, threshold, id_col, text_col)
    stays = (F.col("doc_id") == F.col("component.id")) & (F.col("h1") == F.col("component.h1")) & (F.col("h2") == F.col("component.h2"))
    return rows.filter(~stays).select("doc_id", F.col("h1").alias("h")).distinct()
