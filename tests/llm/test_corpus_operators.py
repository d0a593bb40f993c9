"""Line dedup, quality rules, near duplicates, sharding, SpotSigs and the pipeline against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, SF, prose

import corpus_pipeline
from quillon.llm import linededup, neardup, quality, queries, sharding, spotsigs
from quillon.llm.common import documents


def test_patience_diff():
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert linededup.patience([], [1]) == [] and linededup.patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert linededup.blocks([5, 6, 7], [1, 5, 6, 2, 7], [9, 3, 3, 9, 2]) == [(1, 2)]


def test_line_dedup(make):
    passage = "\n".join(prose(40 + i, 12) for i in range(3))
    own = [prose(60 + i, 10) for i in range(12)]
    texts = [f"{own[0]}\n{passage}\n{own[1]}", f"{own[2]}\n  {passage}\n{own[3]}", f"{own[4]}\n{own[5]}", f"{own[0]}\n{passage}\n{own[1]}", f"short\n{own[6]}", f"short\n{own[7]}", None, "", f"{own[8]}\n{own[8]}"]
    df = make(texts, th=F.lit(1), _id=F.lit(2), _ranges=F.lit(3)).union(make([(0, texts[0]), (None, texts[0])], th=F.lit(1), _id=F.lit(2), _ranges=F.lit(3)))
    got = defaultdict(list)
    for r in linededup.dedup(df, report="cut").collect():
        got[r["doc_id"]].append(r)
    assert [r["text"] for r in got[0]] == [texts[0]] * 2 and got[None][0]["text"] == texts[0]
    assert got[1][0]["text"] == f"{own[2]}\n{own[3]}" and got[1][0]["cut"] == 3 and got[1][0]["n_chars"] == len(got[1][0]["text"])
    assert got[3][0]["text"] == "" and got[6][0]["text"] is None and got[7][0]["text"] == ""
    assert all(got[i][0]["text"] == texts[i] for i in (2, 4, 5, 8))
    assert linededup.dedup(make([])).count() == 0 and linededup.dedup(make(ODD)).count() == len(ODD)


def test_a_line_in_every_document_makes_no_pairs_of_all(make):
    hot = prose(77, 30)
    texts = [f"{prose(100 + i, 9)}\n{hot}" for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(make(texts)).collect()}
    assert got[0] == texts[0] and all(hot not in got[i] for i in range(1, 300))


def test_rows_that_repeat_a_document_send_its_windows_once(make):
    passage, own = "\n".join(prose(40 + i, 12) for i in range(3)), prose(70, 9)
    later = make([None, f"{own}\n{passage}"]).filter("doc_id = 1")
    df = make([passage]).union(later.crossJoin(later.sparkSession.range(200)).select(later.columns))
    ranges = linededup.cuts(df).collect()
    assert len(ranges) == 1 and [tuple(x) for x in ranges[0]["ranges"]] == [(1, 3)]
    assert Counter(r["text"] for r in linededup.dedup(df).collect()) == {passage: 1, own: 200}


def plain_cut(texts):
    """The lines of each text that lie in a run of 5 words or more which any earlier text has as a run."""
    lines = [[x.strip() for x in t.split("\n")] for t in texts]
    runs = [{tuple(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)} for x in lines]
    out = []
    for d, x in enumerate(lines):
        spans = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(len(s.split()) for s in x[a:b]) >= 5 and any(tuple(x[a:b]) in r for r in runs[:d])]
        out.append({k for a, b in spans for k in range(a, b)})
    return out


def test_line_dedup_against_all_earlier_documents(make):
    """Blocks whose lines come first in other documents or in another order, short lines, repeats, scripts without spaces."""
    x, y, z = "one two three four", "five six seven eight", "nine ten eleven twelve"
    p, q = prose(1, 9), prose(2, 9, "v")
    verse = "\n".join(f"{w}a {w}b" for w in "rstu")
    texts = [f"{x}\n{p}", f"{y}\n{q}", f"{x}\n{y}", f"start\n{x}\n{y}\nend", f"{q}\n{p}\n{z}", f"{p}\n{q}\nmore", verse, f"own\n{verse}\nrest", f"{z}\n\nand\n{z}\n\nand", f"{p}\nfirst\n{p}\nlast", f"  {z}\n\nand\t", f"  {z}\n\n\tand  "]
    rng = np.random.default_rng(4)
    pieces = ["", "a", "b c", "d e f", "g h i j", "k l m n o", "p q"]
    texts += ["\n".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(1, 9))) or "-" for _ in range(40)]
    want = plain_cut(texts)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(make(texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "\n".join(s for k, s in enumerate(t.split("\n")) if k not in want[i]), i
        for j in range(i):  # what an alignment with any earlier document finds is cut
            for a, b in linededup.blocks(texts[j].split("\n"), t.split("\n"), [len(s.split()) for s in t.split("\n")]):
                assert set(range(a, b + 1)) <= want[i] or texts[j].startswith("  ")
    assert got[3] == "start\nend" and got[5] == "more" and got[7] == "own\nrest"


def test_line_dedup_counts_characters_of_scripts_without_spaces(make):
    texts = ["上善若水\n水善利万物", "另\n上善若水\n水善利万物", "ภาษาไทยง่าย", "ก\nภาษาไทยง่าย", "道可\n非", "道可\n非"]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(make(texts)).collect()}
    assert got[1] == "另" and got[3] == "ก" and got[5] == texts[5]


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(spark, make):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (make(ODD + ["a b a b a b", "a\nb\n\na\n a", "x y z x y z x y z"], n_wrong=F.lit(1)), documents(spark, SF)):
        for r in quality.figures(df).collect():
            want = plain_figures(r["text"])
            assert tuple(r[n] for n in names) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_exact_binomial_and_choice():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (50, 1000, 0.06)):
        assert math.isclose(quality.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_choice_of_cutoffs():
    grid = {"f": [0.1, 0.2, 0.3], "g": [1.0, 2.0]}
    assert quality.steps(grid) == [("f", 2), ("g", 1), ("f", 1), ("g", 0), ("f", 0)]
    level = quality.levels(grid, 0.05, 2)
    assert len(level) == 2 and math.isclose(level[0] + 5 * level[1], 0.05 / 2)
    assert quality.choose([(500, 0, 0)], grid, 0.02, level) == {"f": 0.1, "g": 1.0}
    assert quality.choose([(20, 0, 0)], grid, 0.02, level) == {}  # too few to show anything
    assert quality.choose([(1000, 0, 0), (100, 2, 0)], grid, 0.02, level) == {"f": 0.3, "g": 1.0}  # f fails at 0.2, g goes on
    assert quality.choose([(1000, 0, 0), (900, 3, 2)], grid, 0.02, level) == {}


def test_choice_keeps_to_the_risk():
    """Over many holdouts the rules' true false rejection exceeds alpha in at most a share delta of them."""
    rng, alpha, delta = np.random.default_rng(3), 0.05, 0.2
    grid = {"f": [0.5, 0.6, 0.7, 0.8, 0.9], "g": [0.9, 0.92, 0.94, 0.96, 0.98]}  # uniform figures: 1 - cutoff is the risk of each
    level, bad = quality.levels(grid, delta, 1), 0
    for _ in range(300):
        x = rng.random((400, 2))
        over = Counter((int(sum(a > c for c in grid["f"])), int(sum(b > c for c in grid["g"]))) for a, b in x)
        got = quality.choose([(n, *k) for k, n in over.items()], grid, alpha, level)
        bad += 1 - min(1.0, got.get("f", 1.0)) * min(1.0, got.get("g", 1.0)) > alpha
    assert bad <= delta * 300


def test_quality_rules_keep_their_promise(spark):
    """Good documents with a figure around 0.03, bad ones around 0.3: the cutoff lies between, and few good ones fall."""
    good = [(i, "en" if i < 2400 else None, 100, 500, 15 + i % 7, 0, 0, False) for i in range(3000)]
    bad = [(i, "en" if i < 3400 else None, 100, 500, 150, 0, 0, False) for i in range(3000, 3500)]
    measured = spark.createDataFrame(good + bad, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(3500)], "doc_id long, quality int, toxic int")
    cutoffs = quality.rules(measured, labels)
    assert 0.04 < cutoffs["en"]["symbol_rate"] < 0.3 and 0.04 < cutoffs[None]["symbol_rate"] < 0.3
    kept = quality.judged(measured, cutoffs).filter("kept")
    assert kept.filter("doc_id >= 3000").count() == 0 and kept.filter("doc_id < 3000").count() >= 0.98 * 3000
    assert quality.rules(measured, labels.limit(0)) == {} and quality.judged(measured, {}).filter("kept").count() == 3500


def test_quality_rules_of_very_many_strata(spark):
    measured = spark.range(1001 * 70).selectExpr("id AS doc_id", "concat('s', id % 1001) AS lang", "100L AS n_words", "500L AS word_chars", "IF(id < 1001 * 60, 15L, 200L) AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words", "false AS base_failed")
    labels = spark.range(1001 * 70).selectExpr("id AS doc_id", "CAST(id < 1001 * 60 AS INT) AS quality", "0 AS toxic")
    cutoffs = quality.rules(measured, labels, alpha=0.25, delta=0.2)
    assert len(cutoffs) == 1001
    assert {(r[0], r[1]) for r in quality.judged(measured, cutoffs).selectExpr("doc_id < 1001 * 60", "kept").distinct().collect()} == {(True, True), (False, False)}


def test_quality_against_duckdb(spark):
    """Small holdouts: the loose risk is certified in all strata, the query's own in one."""
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    verdicts = {}
    for name in ("op4_quality", "quality_loose"):
        got = sorted((tuple(r) for r in queries.queries()[name](spark, "/root/testdata/sf0.01").collect()), key=repr)
        assert got == sorted(con.execute(queries.oracle_sql()[name]).fetchall(), key=repr)
        verdicts[name] = sum(not r[6] and not r[7] for r in got)
    assert 0 < verdicts["op4_quality"] < verdicts["quality_loose"]


def test_quality_keeps_columns_with_its_helpers_names(make):
    df = make(ODD + ODD, _words=F.lit(1), _lines=F.lit(2), _at=F.lit(3))
    out = quality.figures(df)
    assert {"_words", "_lines", "_at"} <= set(out.columns) and out.filter("_words = 1 and _at = 3").count() == 2 * len(ODD)
    assert quality.figures(make([])).count() == 0


def shingled(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def plain_classes(texts):
    """Connected components of all pairs at 0.8, unweighted (weights differ only where documents are many)."""
    s, parent = [shingled(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            both = sum((s[i] & s[j]).values())
            if (texts[i] or "") == (texts[j] or "") or both and both / (sum(s[i].values()) + sum(s[j].values()) - both) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(text, every, tag):
    w = text.split()
    return " ".join(f"{tag}{i}" if i % every == every - 1 else x for i, x in enumerate(w))


def test_near_duplicates(make):
    a, b = prose(200, 400), prose(201, 300)
    texts = ODD + [a, a, edited(a, 130, "p"), edited(a, 190, "q"), edited(a, 9, "far"), b, edited(b, 140, "r"), prose(202, 300), "", None] + [prose(300 + i, 60) for i in range(40)]
    rows = neardup.classes(make(texts, rep=F.lit(1), h1=F.lit(2))).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(texts))] == plain_classes(texts) and len(rows) == len(texts)
    assert neardup.classes(make([])).count() == 0
    assert [tuple(r)[:2] for r in neardup.classes(make([(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "x")])).orderBy("doc_id").collect()] == [(3, 3), (7, 3)]


def test_near_duplicates_of_one_id_with_different_texts(spark, make):
    """Every text has a copy that stays, links are found whichever text an id comes with first, ids join their texts' classes."""
    x, y, z = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(5, x), (5, y), (7, x), (3, y), (9, edited(x, 120, "e")), (8, edited(y, 120, "f")), (4, z), (4, prose(4, 200)), (6, edited(z, 120, "g"))]
    found = neardup.classes(make(rows))
    assert found.columns == ["doc_id", "class_id", "n_spanning_links"]  # not all links
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert got == {3: 3, 5: 3, 7: 3, 8: 3, 9: 3, 4: 4, 6: 4}
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dup(spark, make(rows), SF).collect())
    assert kept == sorted([(5, x), (3, y), (4, z), (4, prose(4, 200))])


def test_near_duplicates_of_many_copies(make):
    """Hundreds of edited copies: those near to one another form one class, those edited too much stay out."""
    base = prose(500, 150)
    texts = [edited(base, 149 if i % 2 else 12, f"e{i}x") for i in range(240)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(texts)).collect()}
    want = plain_classes(texts)
    assert [got[i] for i in range(240)] == want and len(set(want)) == 121


def test_consistent_sampling_estimates_weighted_jaccard():
    rng, tables = np.random.default_rng(1), neardup.draws()
    h = np.sort(rng.integers(0, 1 << 63, 600, np.uint64))
    w = rng.random(600).astype(np.float32) + 0.5
    agree, trials = 0, 30
    for t in range(trials):
        tables = neardup.draws(100 + t)
        agree += (neardup.samples(h[:500], w[:500], tables) == neardup.samples(h[100:], w[100:], tables)).mean()
    want = w[100:500].sum() / w.sum()
    assert abs(agree / trials - want) < 0.06


def test_sharding(spark, make):
    rows = queries.op7_sharding(spark, "/root/testdata/sf0.01").collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 1000 and set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 34_000  # the longest text
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r["law"] for r in rows} == {"bytes"}
    odd = sharding.shards(make(ODD + ODD, node=F.lit(1), k0=F.lit(2)).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(odd) == 2 * len(ODD) and {r["size"] for r in odd if r["doc_id"] == 0} == {1}
    assert sharding.shards(make([])).count() == 0
    many = sharding.shards(make(["same text"] * 640))
    assert {r["count"] for r in many.groupBy("shard").count().collect()} == {40}


def test_sharding_tells_all_sources_apart(make):
    df = make([prose(i, 20) for i in range(80)]).withColumn("source", F.format_string("crawl-2024-%02d", F.col("doc_id") % 40))
    ranks = {r["source"]: r["k"] for r in sharding.ranked(df, "source", "k").collect()}
    assert [ranks[s] for s in sorted(ranks)] == list(range(1, 41))
    assert {r["k"] for r in sharding.ranked(df.withColumn("source", F.when(F.col("doc_id") > 0, F.lit("x"))), "source", "k").collect()} == {0, 1}
    named = sharding.shards(df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), 4)
    assert named.select("doc_id").distinct().count() == 80 and {r["shard"] for r in named.collect()} == set(range(4))


def test_spotsigs(make):
    texts = ["the cat sat on the mat and the dog ran to the old house by the sea " * 4 + prose(7, 30), "un deux trois", None, "", "zzz yyy xxx www"] + ODD
    near = spotsigs.beside_next(make(texts, sets=F.lit(1), _key=F.lit(2)))
    rows = {r["doc_id"]: r for r in near.collect()}
    assert spotsigs.fingerprints(make(texts, _w=F.lit(1), _p=F.lit(2)), "text", "sets").filter("_w = 1 and _p = 2").count() == len(texts)
    order = sorted(rows, reverse=True)
    for i, d in enumerate(order):
        assert rows[d]["next_text"] == (texts[order[(i + 1) % len(order)]] or "") and rows[d]["next_sets"] == rows[order[(i + 1) % len(order)]]["sets"]
    cut = {r["doc_id"]: r["e"] for r in near.select("doc_id", spotsigs.edited(F.col("text"), F.col("next_text")).alias("e")).collect()}
    for i, d in enumerate(order):
        t, n = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(t) // 3
        assert cut[d] == t[: len(t) - k] + n[:k]
    assert spotsigs.beside_next(make([])).count() == 0
    one = spotsigs.beside_next(make([(5, "alone")])).collect()
    assert one[0]["next_text"] == "alone"


def test_spotsigs_of_texts_with_anchors_at_the_end_only(make):
    texts = ["Chapter 3", "Version 10", "Eser thed nt of.", "", " .", "the of", "alone"]
    sets = {r["doc_id"]: tuple(r["sets"]) for r in spotsigs.fingerprints(make(texts), "text", "sets").collect()}
    assert [len(sets[i]) for i in range(len(texts))] == [2, 2, 4, 0, 0, 2, 1] and len(set(sets.values())) == 6
    near = {r["doc_id"]: r["near_class"] for r in spotsigs.near_classes(make(texts)).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}


def plain_spots(text):
    """The signatures of a text as anchors and chains, written as the method says."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    common = [len(w) <= 2 or w in spotsigs.ANCHORS for w in words]
    content = [i for i, c in enumerate(common) if not c]
    found = {(words[i - 1], *[words[j] for j in content if j >= i][: spotsigs.CHAIN]) for i in content if i and common[i - 1]}
    return found or {tuple(words[i : i + spotsigs.CHAIN]) for i in range(len(words))}


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def spot_classes(rows, threshold=0.8):
    """All pairs of documents (id, text)."""
    sets, least = [plain_spots(t) for _, t in rows], {i: i for i, _ in rows}
    joined = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if likeness(sets[i], sets[j]) >= threshold - 1e-9]
    changed = True
    while changed:
        changed = False
        for a, b in joined:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_spotsigs_against_all_pairs(spark, make):
    """Documents of the test tables, and copies edited by the hundreds that resemble one another more or less."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    assert {r["doc_id"]: r["near_class"] for r in queries.spotsigs_near(spark, SF).collect()} == spot_classes(rows)
    base = " ".join(f"the {x} of {y}" for x, y in zip(prose(1, 60, "ab").split(), prose(2, 60, "cd").split()))
    rows = [(i, edited(base, [239, 31, 19][i % 3], f"e{i}x")) for i in range(150)] + [(200, base + " end"), (201, None), (202, ""), (203, "the of")]
    want = spot_classes(rows)
    assert {r["doc_id"]: r["near_class"] for r in spotsigs.near_classes(make(rows)).collect()} == want and 20 < len(set(want.values())) < 140
    assert spotsigs.near_classes(make([])).count() == 0


def test_spotsigs_query_against_plain_sets(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for r in queries.op8_spotsigs(spark, SF).collect():
        t, n = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        k = len(t) // 3
        cut = t[: len(t) - k] + n[:k]
        assert r["edited_sha256"] == hashlib.sha256(cut.encode()).hexdigest() and r["n_chars"] == len(t)
        assert abs(r["near_edited"] - likeness(plain_spots(t), plain_spots(cut))) < 1e-9 and abs(r["near_next"] - likeness(plain_spots(t), plain_spots(n))) < 1e-9
        assert len(plain_spots(t)) == len(r["fingerprint"].split(",") if r["fingerprint"] else [])


def test_next_of_rows_that_share_an_id(make):
    """Thousands of rows of one id, or without one, spread over the ranges, and each row still has the next."""
    rows = [(7, prose(i, 3)) for i in range(2500)] + [(None, prose(i, 4, "n")) for i in range(1500)] + [(9, "first"), (3, "third")]
    got = spotsigs.beside_next(make(rows)).collect()
    assert len(got) == len(rows) and Counter(r["next_text"] for r in got) == Counter(t for _, t in rows)
    assert [r["next_text"] for r in got if r["text"] == "first"][0].startswith("w") and sum(r["next_text"] == "third" for r in got) == 1


def test_neighbours_differ(spark):
    r = queries.op8_spotsigs(spark, SF).agg(F.avg("near_edited"), F.avg("near_next"), F.count("*")).first()
    assert r[0] > 0.35 and r[1] < 0.05 and r[2] == 200


def test_pipeline(spark):
    docs = documents(spark, SF)
    names, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs.cache(), SF)
        if name != "packing":
            assert docs.columns == names
            assert docs.count() > 0.6 * before.count()
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} <= ids and max(r["offset"] + r["length"] for r in rows) <= 1024


def test_pipeline_stages_against_brute_force(spark, make):
    """Each stage's decisions on its own input."""
    shared = "\n".join(prose(40 + i, 12) for i in range(3))
    texts = [prose(i, 120) for i in range(12)] + [f"{prose(50, 30)}\n{shared}", f"{prose(51, 30)}\n{shared}\n{prose(52, 20)}", edited(prose(0, 120), 70, "e"), edited(prose(1, 120), 9, "f"), "password = 'Zq8x-Lp2vR9'", "12 34", None, ""]
    docs = make(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert kept == {i for i, t in enumerate(texts) if t and re.search("[a-z]", t)}
    docs = docs.filter(F.col("doc_id").isin(sorted(kept)))
    cut, texts = plain_cut([texts[i] for i in sorted(kept)]), {i: texts[i] for i in sorted(kept)}
    docs = corpus_pipeline.line_dedup(spark, docs, SF)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in c) for (i, t), c in zip(texts.items(), cut)}
    docs = corpus_pipeline.near_dup(spark, docs, SF)
    ids, classes = sorted(got), plain_classes([got[i] for i in sorted(got)])
    assert {r["doc_id"] for r in docs.collect()} == {ids[c] for c in classes}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = corpus_pipeline.secret_scan(spark, docs, SF)
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i for i in after if after[i] != before[i]} == {i for i, t in before.items() if "password" in t}
    rows, used = corpus_pipeline.pack(spark, docs, SF).collect(), Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in rows} == set(after) and max(used.values()) <= 1024


def test_run_leaves_no_tables_of_its_stages_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillon.llm.common.shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, SF).count() > 100
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {f"stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1]} | {"pieces"}


def test_language_stage_without_labels(spark, make):
    docs = make(ODD + [prose(1, 60)]).withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).select("doc_id").collect()}
    assert got == {i for i, t in enumerate(ODD + [prose(1, 60)]) if t and any(c.isalpha() for c in t)} and len(got) > 5


def test_pipeline_on_odd_rows(spark, make):
    docs = make(ODD + [prose(i, 60) for i in range(10)], _gone=F.lit(1), _said=F.lit(2))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-2:] == ["_gone", "_said"], name
    assert docs.count() > 10
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
