"""Line dedup: later documents lose the blocks of lines that they share, in order, with an earlier document.

A block is a run of consecutive lines with at least `block_words` words that any earlier document has as a run, too; all
its lines are cut. Every such run is covered by its windows: the shortest runs of enough words that start at a line, and
those that end at one. Words follow from the lines, so both documents have the same windows in the run.

Overlapping documents are found through the hashes of their windows: a later document meets, for each of its windows,
the least document that has it. Hashes that many documents share lead all of them to that one document, so a window
that a third of all documents hold gives one row for each of them, and never pairs of its holders. With each document it
meets, a later one is aligned by patience diff over the windows that lead it there (nothing else of the texts is sent).
What is aligned is cut. Windows that the alignment leaves out (passages in another order, or repeated) are aligned again
among themselves, so that in the end every window has been aligned with an earlier document, whichever holds it.

Words are separated by white space; in scripts that are written without it (Han, kana, Thai, Lao, Khmer, Burmese,
Tibetan) each character counts as one. Lines without words have none, but belong to the runs that they stand in.

"Later" is the larger doc_id (ties by a hash of the text). Lines are compared without white space at their ends. Null
texts and empty texts stay as they are; a document that is a copy as a whole becomes empty and stays as a row (if it has
`block_words` words). Rows that repeat a document (id and text) are edited alike and not against each other; lines that
repeat inside a document stay unless an earlier one has them. Rows without id stay as they are. An empty table stays
empty. Other columns pass through; n_chars follows if it is there.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, fresh, materialize

BLOCK_WORDS = 5
#: Patience diffs of a pair before the windows left are taken one by one.
PASSES = 4
#: A character of a script that puts no space between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Hashes of runs are differences of prefix hashes modulo a prime.
PRIME, FACTOR = (1 << 89) - 1, 0x1D8AF066E5C1F2A7B39D51


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i in a, j in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        ca, cb = Counter(a[lo:hi]), Counter(b[low:high])
        where = {x: i for i, x in enumerate(a[lo:hi], lo) if ca[x] == 1}
        both = [(where[x], j) for j, x in enumerate(b[low:high], low) if cb[x] == 1 and x in where]
        if not both:
            continue
        tops: list[int] = []  # longest increasing subsequence of the positions in a
        piles: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(both):
            p = bisect_left(tops, i)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(i)
                piles.append(k)
            else:
                tops[p], piles[p] = i, k
        k, chain = piles[-1], []
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        chain.reverse()
        out += chain
        edges = [(lo - 1, low - 1), *chain, (hi, high)]
        todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(edges, edges[1:]) if i + 1 < x and j + 1 < y]
    return sorted(out)


def blocks(source: list[int], later: list[int], words: list[int], block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Runs [first, last] of lines of `later` that align with consecutive lines of `source` and have enough words."""
    runs: list[list[int]] = []
    for i, j in patience(source, later):
        if runs and runs[-1][1] == j - 1 and runs[-1][2] == i - 1:
            runs[-1][1:] = [j, i]
        else:
            runs.append([j, j, i])
    return [(a, b) for a, b, _ in runs if sum(words[a : b + 1]) >= block_words]


def aligned(shared: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of lines of a later document that align with one earlier document, from their shared windows.

    shared: (first and last line in the later document, first and last line in the earlier one). Windows that patience
    diff leaves out are aligned again; what is left after `PASSES` is aligned window by window.
    """
    out: list[tuple[int, int]] = []
    for _ in range(PASSES):
        if not shared:
            break
        later = sorted(shared)
        source = sorted({x[2:] for x in shared})
        number = {x: i for i, x in enumerate(source)}
        found = {j for _, j in patience(list(range(len(source))), [number[x[2:]] for x in later])}
        if not found:
            break
        out = united(out + [later[j][:2] for j in found])
        covered = lambda a, b: (i := bisect_right(out, (a, math.inf))) and out[i - 1][1] >= b
        shared = [x for j, x in enumerate(later) if j not in found and not covered(*x[:2])]
    return united(out + [x[:2] for x in shared])


def windows(h: list[int], w: list[int], block_words: int = BLOCK_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first, last) of the shortest runs of `block_words` words from each line on and up to each line."""
    n, prefix, power, said = len(h), [0], [1], [0]
    for x, k in zip(h, w):
        prefix.append((prefix[-1] * FACTOR + x % PRIME) % PRIME)
        power.append(power[-1] * FACTOR % PRIME)
        said.append(said[-1] + k)
    runs, b = [], 0
    for a in range(n):
        while b < n and said[b + 1] - said[a] < block_words:
            b += 1
        if b == n:
            break
        runs.append((a, b))
    a = 0
    for b in range(n):
        if said[b + 1] - said[0] < block_words:
            continue
        while said[b + 1] - said[a + 1] >= block_words:
            a += 1
        runs.append((a, b))
    return [((prefix[b + 1] - prefix[a] * power[b + 1 - a]) % PRIME & (1 << 63) - 1, a, b) for a, b in sorted(set(runs))]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same lines in as few runs as there can be."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cuts(df: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), ranges array<struct<a, b>>: the runs of lines to cut, for documents that lose any."""
    bounded_batches(df.sparkSession)
    line = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    apart = lambda x: F.when(F.octet_length(x) > F.length(x), F.trim(F.regexp_replace(x, UNSPACED, " x "))).otherwise(x)
    own = df.filter("doc_id is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("th"), line.alias("line"))
    own = own.select("doc_id", "th", F.transform("line", lambda x: F.xxhash64(x)).alias("h"), F.transform("line", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(apart(x), r"\s+")))).alias("w"))
    kind = df.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    window_type = pa.list_(pa.struct([("s", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"s": s, "a": a, "b": b} for s, a, b in windows(h, w, block_words)] for h, w in zip(batch.column("h").to_pylist(), batch.column("w").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found, window_type)], ["doc_id", "th", "windows"])

    said = materialize(own.mapInArrow(find, f"doc_id {kind}, th long, windows array<struct<s:bigint,a:int,b:int>>"), "windows")
    said = said.select(F.struct("doc_id", "th").alias("d"), F.explode("windows").alias("x")).select("d", "x.s", "x.a", "x.b")
    shared = said.groupBy("s").agg(F.min(F.struct("d", "a", "b")).alias("first"), F.max("d").alias("last")).filter("first.d < last").select(F.col("s").alias("of"), "first")
    shared = materialize(shared, "shared")  # read back, so that a join on it can split the windows that many documents have
    held = said.join(shared, F.col("s") == F.col("of")).filter("first.d < d").select("d.doc_id", "d.th", F.struct(F.xxhash64("first.d").alias("source"), "a", "b", F.col("first.a").alias("c"), F.col("first.b").alias("e")).alias("x"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for shared in batch.column("shared").to_pylist():
                met: dict[int, list[tuple[int, int, int, int]]] = {}
                for x in shared:
                    met.setdefault(x["source"], []).append((x["a"], x["b"], x["c"], x["e"]))
                runs.append([{"a": a, "b": b} for a, b in united([r for one in met.values() for r in aligned(one)])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(runs, run_type)], ["doc_id", "th", "ranges"])

    return held.groupBy("doc_id", "th").agg(F.collect_set("x").alias("shared")).mapInArrow(align, f"doc_id {kind}, th long, ranges array<struct<a:int,b:int>>")


def dedup(df: DataFrame, block_words: int = BLOCK_WORDS, report: str | None = None) -> DataFrame:
    """The table with the shared blocks cut from `text`; `report` names a new column for how many lines went."""
    i, th, r, new = (fresh(df, c) for c in ("_id", "_th", "_ranges", "_new"))
    cut = cuts(df, block_words).select(F.col("doc_id").alias(i), F.col("th").alias(th), F.col("ranges").alias(r))
    got = df.join(cut, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(th)), "left")
    keep = F.filter(F.split("text", "\n"), lambda x, k: ~F.exists(r, lambda y: (y["a"] <= k) & (k <= y["b"])))
    got = got.withColumn(new, F.when(F.col(r).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")))
    lost = F.when(F.col(r).isNull(), 0).otherwise(F.size(F.split("text", "\n")) - F.size(keep)).cast("long")
    names = [F.col(new).alias("text") if c == "text" else F.length(new).cast(df.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in df.columns]
    return got.select(*names, *([lost.alias(report)] if report else []))
