"""Every operator on rows with nulls, repeats, odd texts and clashing columns, against plain Python."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import chat, decontamination, line_dedup, near_duplicates, packing, pii, quality, suffix_dedup, token_store, toxicity
from leadloom.llm.tokenize import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def bag(found):
    return Counter(tuple(r) for r in found)


def test_quality_counts(docs, rows, none):
    def counts(text):
        w = WORD.findall(text or "")
        ls = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(again)

    judged = quality.judge(docs.drop("n_words", "kept"))
    got = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    expected = []
    for r in rows:
        c = counts(r[1])
        expected.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert bag(got) == bag(expected)
    assert quality.clean(docs).columns == docs.columns and quality.clean(none).count() == 0


@pytest.mark.parametrize(
    "line, bad",
    [("A sentence that ends.", False), ("", False), ("Home | About | Team | Contact", True), ("no end here", True), ("BUY!! NOW!! TODAY!! ONLY!!", True), ("a%%% b&&& c***.", True), ("All rights reserved.", True),
     ("Licensed under the Apache License, Version 2.0.", True), ("First one. Then an open end", False)],
)
def test_quality_lines(spark, line, bad):
    assert spark.createDataFrame([(line,)], "x string").select(quality.failing(F.col("x"), F.lit(True))).first()[0] is bad


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    own = defaultdict(set)
    for doc, sets in rows:
        own[doc].add(sets)
    parent = {d: d for d in own}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    flat = [(d, s) for d, group in own.items() for s in group if s]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in own}


def test_near_duplicates(docs, rows, none):
    known = components([(r[0], shingles(r[1])) for r in rows if r[0] is not None])
    expected = bag((r[0], len(shingles(r[1])), known.get(r[0])) for r in rows)
    assert bag(near_duplicates.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()) == expected
    kept = near_duplicates.keep_one(docs.withColumn("_kept", F.lit(1)).withColumn("Again", F.lit(2)))
    assert kept.columns == [*docs.columns, "_kept", "Again"]
    assert {r["doc_id"] for r in kept.collect()} == {d for d in known if known[d] == d} | {None}
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_of_random_sets(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60)) for _ in range(rng.randint(5, 70))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 9))
            texts.append(copy[rng.randint(0, 2) :])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    known = components([(i, shingles(t)) for i, t in rows])
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == known


@pytest.mark.parametrize("block", [1, 2])
def test_near_duplicates_of_many_exact_copies(spark, monkeypatch, block):
    # Lists are dealt by the number of copies, while few documents stand for them: each may be alone in its block.
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(17)
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(120)]
        for k in range(30 + 2):
            copy = list(base)
            if k >= 30:
                copy[rng.randrange(30, 90)] = f"new{group}x{k}"
            rows.append((len(rows), " ".join(copy)))
    known = components([(i, shingles(t)) for i, t in rows])
    assert len(set(known.values())) == 12
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == known


def test_parity_maps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) > len(b):
            a, b = b, a
        maps = near_duplicates.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        asked = [np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]), maps, np.array([True, True]), np.array([True, True])]
        if len(a) and 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(near_duplicates.proposals(*asked, True)) == {(0, 1), (1, 0)} and near_duplicates.proposals(*asked, False) == [(0, 1)]


def test_parity_maps_are_short_and_tell_sets_apart():
    rng = np.random.default_rng(5)
    for n, common in ((40, 26), (1000, 800), (5000, 4000)):
        # Similarities of 0.48 to 0.67: no link; the maps of large sets have four bits a member at most.
        members = np.unique(rng.integers(0, 1 << 63, 3 * n).astype(np.uint64))
        members = rng.permutation(members)
        a, b = np.sort(members[:n]), np.sort(members[n - common : 2 * n - common])
        maps = near_duplicates.parities(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert all(8 * len(m) <= max(512, 4 * n) for m in maps)
        both = [np.array([1, 2]), np.array([1, 2]), np.array([n, n]), maps, np.array([True, True]), np.array([True, True])]
        assert near_duplicates.proposals(*both, True) == []


def test_near_duplicates_hold_little_memory():
    rng = random.Random(41)
    texts = ["", *(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice((2, 40, 900)))) for _ in range(300)), "x y", ""]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    near_duplicates.Rolling._tables(len(data))
    assert len(data) > 1.5 * near_duplicates.PIECE
    (sets, cuts), most = peak(lambda: near_duplicates.shingle_sets(data, at))
    each = [near_duplicates.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert [sets[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [x.tolist() for x in each]
    assert most < 30 * near_duplicates.PIECE
    # All 499,500 pairs of a cell of equal maps.
    n = 1000
    members = [np.arange(n), np.arange(n), np.full(n, 70), [bytes(64)] * n, np.ones(n, bool), np.ones(n, bool), True]
    pairs, most = peak(lambda: near_duplicates.proposed_sides(*members))
    assert pairs.shape == (n * (n - 1), 2) and most < 32 * len(pairs)


@pytest.mark.parametrize("tile, block", [(4, 3), (16, 1)])
def test_near_duplicates_in_many_cells(spark, monkeypatch, tile, block):
    # Large stars are cut into cells: near copies, and chains of them that only some members link.
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(23)
    rows = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(90)]
        for k in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(90)] = f"n{group}x{rng.randint(0, 5)}"
            rows.append((len(rows), " ".join(copy)))
    known = components([(i, shingles(t)) for i, t in rows])
    assert 4 < len(set(known.values())) < 100
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == known


def test_only_what_was_proposed_goes_to_the_next_turn(spark):
    # Star 1 holds sets that cannot link, star 5 a pair that may and a set that cannot.
    sets = {1: range(0, 100), 2: range(500, 600), 5: range(1000, 1100), 6: range(1001, 1101), 7: range(2000, 2100)}
    hashed = [np.sort(near_duplicates.mix(np.array(list(v), np.uint64))) for v in sets.values()]
    maps = near_duplicates.parities(np.concatenate(hashed), np.arange(len(sets) + 1) * 100)
    known = spark.createDataFrame([(d, 100, bytearray(m)) for d, m in zip(sets, maps)], "doc_id long, n_shingles long, parity binary")
    starred = spark.createDataFrame([(1, 1, 100), (1, 2, 100), (5, 5, 100), (5, 6, 100), (5, 7, 100)], near_duplicates.STARS)
    made = near_duplicates.proposed(near_duplicates.first_cells(starred), known, False, partial=True)
    assert [tuple(r) for r in made.filter("a IS NOT NULL").select("a", "b").collect()] == [(6, 5)]
    nothing = spark.createDataFrame([], "id long, component long")
    left = near_duplicates.unsettled(starred, nothing, made)
    assert sorted(tuple(r) for r in left.collect()) == [(5, 5, 5), (5, 6, 6)]
    joined = spark.createDataFrame([(5, 5), (6, 5)], "id long, component long")
    assert near_duplicates.unsettled(left, joined, made).count() == 0
    # Of the texts only those that pairs name are dealt out.
    texts = spark.createDataFrame([(i, bytearray(b"x")) for i in range(100)], "id long, body binary")
    assert sorted(r[0] for r in near_duplicates.asked_texts(texts, spark.createDataFrame([(3,), (4,)], "id long")).collect()) == [3, 4]


@pytest.mark.parametrize("most", [1 << 20, 3000])
def test_pairs_that_may_link_are_no_rows(spark, monkeypatch, most):
    # Sixteen groups of copies whose parity maps leave many pairs of two groups open, of which only those with the last row link.
    monkeypatch.setattr(near_duplicates, "SHINGLES", most, raising=False)
    texts = []
    for place in range(4, 80, 5):
        for k in range(12):
            copy = [f"w{i}" for i in range(90)]
            copy[place] = f"new{place}x{k}"
            texts.append(copy)
    # It has a changed word of each of two groups, so that these two join.
    texts.append([f"w{i}" for i in range(90)])
    texts[-1][4], texts[-1][9] = "new4x0", "new9x0"
    random.Random(3).shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    known = components([(i, shingles(t)) for i, t in rows])
    assert len(set(known.values())) == 15
    counted, verified = [], near_duplicates.verified

    def count(pairs, texts):
        counted.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(near_duplicates, "verified", count)
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == known
    assert sum(counted) < 4 * len(rows)


def test_boundary_follows_the_lists():
    sizes = {3: 1000, 6: 1000, 12: 1000}
    assert near_duplicates.boundary(sizes, 0.0) <= near_duplicates.boundary(sizes, 50.0) <= near_duplicates.boundary(sizes, 1e6)
    assert near_duplicates.boundary({}, 1.0) == 0 and near_duplicates.boundary({5: 10}, 1e9) >= 5


def test_suffix_dedup(docs, rows, none):
    size = 400
    # Rows equal in both columns get equal results.
    starts = Counter(t[i : i + size] for t in ((r[1] or "").encode() for r in rows) for i in range(len(t) - size + 1))
    expected = []
    for r in rows:
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if starts[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        expected.append((r[0], len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert bag(got) == bag(expected)
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("around", [1, 2048])
def test_suffix_dedup_of_a_shared_core(spark, monkeypatch, around):
    # One passage in many surroundings, near copies of it, and a core that more surroundings have than are compared at once.
    monkeypatch.setattr(suffix_dedup, "MOST_AROUND", around)
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(700)
    texts = [letters(rng.randint(0, 300)) + passage[rng.randint(0, 150) : rng.randint(500, 700)] + letters(rng.randint(0, 300)) for _ in range(14)]
    broken = list(passage)
    broken[350] = "Z"
    texts += ["".join(broken), passage + letters(20) + passage, letters(900), letters(399)]
    starts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    expected = {}
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        expected[k] = (sum(gone), "".join(c for c, g in zip(t, gone) if not g))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(table).collect()} == expected


def test_suffix_index_takes_a_batch_to_stored_levels(spark, tmp_path):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = letters(600)
    batches = [[letters(2000), letters(100) + shared], [letters(1500)], [shared + letters(50), letters(800)], [letters(700)]]
    tables = [spark.createDataFrame([(t,) for t in b], "text string") for b in batches]
    index = suffix_dedup.SuffixIndex()
    counts = [index.add(suffix_dedup.suffixes(t)).count() for t in tables[:2]]
    assert counts == [0, 0] and [size for size, _ in index.levels] == [2]
    index.save(f"file://{tmp_path}/index")
    stored = suffix_dedup.SuffixIndex.load(spark, f"file://{tmp_path}/index")
    found = {bytes(r["suffix"]).decode() for r in stored.add(suffix_dedup.suffixes(tables[2])).collect()}
    assert found and all(x in shared for x in found)
    assert stored.add(suffix_dedup.suffixes(tables[3])).count() == 0 and [size for size, _ in stored.levels] == [4]
    whole = stored.levels[0][1]
    kept = [bytes(r["suffix"]) for r in whole.collect()]
    assert len(kept) == len(set(kept)) and whole.agg(F.sum("n")).first()[0] == sum(suffix_dedup.suffixes(t).count() for t in tables)
    # Each file is a run of the array in the order of the suffixes' bytes.
    ordered = whole.withColumn("p", F.spark_partition_id()).collect()
    for p in {r["p"] for r in ordered}:
        own = [bytes(r["suffix"]) for r in ordered if r["p"] == p]
        assert own == sorted(own)


def test_repeated_starts_do_not_rest_on_hashes(monkeypatch):
    rng = random.Random(2)
    base = bytes(rng.randrange(97, 105) for _ in range(900))
    around = [base[:450], base[10:480], bytes(rng.randrange(97, 105) for _ in range(440)), base[30:470]]
    core = np.array([1, 1, 1, 2])
    count = Counter((c, a[i : i + 400]) for c, a in zip(core.tolist(), around) for i in range(len(a) - 399))
    expected = [count[c, a[i : i + 400]] > 1 for c, a in zip(core.tolist(), around) for i in range(len(a) - 399)]
    assert suffix_dedup.repeated_starts(core, around)[1].tolist() == expected
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x % np.uint64(7))
    assert suffix_dedup.repeated_starts(core, around)[1].tolist() == expected


def test_line_dedup(docs, rows, none):
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            holders[key(x)].add((r[0], r[1]))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    expected = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(-1 if h[0] is None else h[0] for h in holders[key(x)]) != (-1 if r[0] is None else r[0]))]
        expected.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == Counter(expected)
    clashing = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("_keep", "_doc", "_hash", "_size", "mark_keep", "Mark_Doc")))
    assert line_dedup.dedup_lines(clashing).columns == [*clashing.columns, "n_lines", "n_dropped"] and line_dedup.dedup_lines(clashing).count() == len(rows)
    assert line_dedup.dedup_lines(none).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    words = ["w" + str(i) for i in range(300)]
    texts = [(i, " ".join(rng.choices(words, k=40) + (["vilest", "vilely"] if i % 10 == 0 else []))) for i in range(800)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    # Labels are known for the first half only.
    assert all((scores[i] >= 0.5) == (i % 10 == 0) for i in range(400, 800))
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    unlearnt = toxicity.fit(table, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, unlearnt).collect()} == {0.0}
    assert toxicity.fit(none, labels.limit(0)).bias.size == 0


def test_risk_and_its_slope():
    rng = np.random.default_rng(4)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        z, toxic = rng.normal(size=40) + shift * (np.arange(40) < 20), np.arange(40) < 20
        loss = lambda x: np.log1p(np.exp(-x))
        positive = lambda v: prior * loss(v[toxic]).mean()
        clean = lambda v: loss(-v[~toxic]).mean() - prior * loss(-v[toxic]).mean()
        assert np.isclose(toxicity.risk(z, toxic, prior)[0], positive(z) + max(0, clean(z)))
        followed = (lambda v: positive(v) + clean(v)) if clean(z) > 0 else (lambda v: -clean(v))
        numeric = [(followed(z + h) - followed(z - h)) / 2e-5 for h in 1e-5 * np.eye(40)]
        assert np.allclose(toxicity.risk(z, toxic, prior)[1], numeric, atol=1e-6)
    assert clean(z) < 0


def test_decontamination(spark, docs, rows, none):
    rng = random.Random(8)
    items = [(i, " ".join("q" + str(rng.randint(0, 3000)) for _ in range(rng.randint(12, 150))) + ". " + " ".join("z" + str(rng.randint(0, 900)) for _ in range(6)) + ".") for i in range(300)]
    held = [(1000 + i, " ".join("f" + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 400))) + " " + (text if i % 3 else text.upper()) + " tail words", None) for i, text in items[::7]]
    partial = [(5000 + i, text[: len(text) // 4], None) for i, text in items[::11]]
    table = spark.createDataFrame([*held, *partial], "doc_id long, text string, extra string").unionByName(docs.select("doc_id", "text", F.lit("x").alias("extra")))
    benchmark = spark.createDataFrame([*items, (None, "no id"), (900, None), (901, ""), (5, items[5][1])], "item_id long, text string")
    found = decontamination.leaks(table, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(1000 + i, i) for i, _ in items[::7]}
    assert {r["doc_id"] for r in found.collect()} == {d for d, _, _ in held}
    assert decontamination.leaks(none, benchmark).count() == 0 and decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.keep_clean(docs, benchmark).count() == len(rows)


def test_bounds_lose_no_score():
    """All pairs that reach the threshold by plain summation are retrieved."""
    rng = random.Random(4)
    items = [(i, " ".join("t" + str(int(rng.random() ** 2 * 200)) for _ in range(rng.randint(3, 40)))) for i in range(150)]
    hashes = [decontamination.text_words(t) for _, t in items]
    terms, df = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    index = decontamination.build(items, 64, decontamination.Statistics(len(items), float(np.mean([len(h) for h in hashes])), terms, df))
    window, term = [], []
    for w in range(300):
        some = sorted(rng.sample(range(len(index.terms)), 60) if w % 2 else set(index.item_terms[index.item_at[w // 2] : index.item_at[w // 2 + 1]][: rng.randint(1, 40)].tolist()))
        window += [w] * len(some)
        term += some
    window, term = np.array(window), np.array(term)
    got = set(zip(*(x.tolist() for x in decontamination.retrieve(index, window, term)[:2])))
    for w in range(300):
        there = set(term[window == w].tolist())
        for i in range(len(items)):
            at = slice(index.item_at[i], index.item_at[i + 1])
            score = sum(x for t, x in zip(index.item_terms[at].tolist(), index.item_weights[at].tolist()) if t in there)
            if abs(score - decontamination.THRESHOLD) > 1e-6:
                assert ((w, i) in got) == (score > decontamination.THRESHOLD)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    packed = [r.asDict() for r in packing.pack(docs, path).collect()]
    streams = Counter()
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), packing.SEQUENCE):
            streams[r[0], k, tuple(ids[k : k + packing.SEQUENCE]), len(ids)] += 1
    assert Counter((p["doc_id"], p["start"], tuple(np.frombuffer(p["ids"], "<u4").tolist()), p["doc_tokens"]) for p in packed) == streams
    for sequence in {p["sequence_id"] for p in packed}:
        end = 0
        for p in sorted((p for p in packed if p["sequence_id"] == sequence), key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= packing.SEQUENCE
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    from tokenizers import Tokenizer

    from leadloom.llm.tokenize import encoder

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|ENDOFTEXT|> x", "a<|startoftext|>b, c. D", "", "Plain words, and more.", " ", "tab\there", "Ünï çode\u00a0space", "two  blanks", "line\n\nbreak"]
    plain = Tokenizer.from_file(vocabulary(name))
    assert [x.tolist() for x in encoder(vocabulary(name)).texts(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 400)
    path = vocabulary("byte_bpe_50k.json")
    for rows in ([(7, "one text")] * 200, [(7, f"text {i}") for i in range(200)]):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        packed = [sorted((r["doc_id"], r["start"], r["length"], r["ids"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in packing.pack(table.repartition(n), path).collect()) for n in ((3, 3, 7) if rows[0] != rows[1] else (3, 3))]
        assert len(packed[0]) == 200 and all(p == packed[0] for p in packed) and len({p[5] >> 32 for p in packed[0]}) > 8


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, packing.SEQUENCE + 1, 500)
    bins, offsets = packing.first_fit_decreasing(lengths)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(packing.SEQUENCE)
        assert (bins[i], offsets[i]) == (k, packing.SEQUENCE - room[k])
        room[k] -= lengths[i]


def test_token_store(docs, rows, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    store = token_store.write(docs, path)
    found = token_store.read(store).collect()
    expected = Counter((r[0], tuple([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == expected
    end = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == end
        end += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order)
    digests = [r["digest"] for r in store.chunks.collect()]
    assert len(digests) == len(set(digests)) > 0
    assert token_store.read(token_store.write(none, path)).count() == 0
    broken = [
        token_store.Store(store.documents, store.chunks.withColumn("ids", F.concat("ids", F.lit(bytearray(b"xx")))), store.manifest, store.id_bytes), token_store.Store(store.documents, store.chunks.limit(3), store.manifest, store.id_bytes),
        token_store.Store(store.documents.filter("place != 1"), store.chunks, store.manifest, store.id_bytes), token_store.Store(store.documents.unionByName(store.documents.limit(1)), store.chunks, store.manifest, store.id_bytes),
        token_store.Store(store.documents, store.chunks, store.manifest.limit(1), store.id_bytes),
    ]
    for wrong in broken:
        with pytest.raises(Exception, match="do not match"):
            token_store.read(wrong).collect()
    # A second batch finds the chunks of the first by their digests.
    more = token_store.write(docs.filter("doc_id < 5").unionByName(docs.filter("doc_id = 1").withColumn("text", F.lit("something else altogether"))), path, store.chunks)
    assert more.chunks.count() == store.chunks.count() + 1 and token_store.read(more).count() == docs.filter("doc_id < 5").count() + docs.filter("doc_id = 1").count()


def test_chunks_of_one_document_are_not_looked_up(docs):
    store = token_store.write(docs, vocabulary("word_bpe_49k.json"))
    roots = {r["root"]: r for r in store.documents.collect()}
    homes = [r for r in store.chunks.collect() if r["home"] is not None]
    assert homes and all(roots[r["home"]]["recipe"].count(r["digest"]) == 1 for r in homes)
    assert all(len(r["common"]) == len(r["recipe"]) for r in roots.values())
    assert "home" in token_store.read(store)._jdf.queryExecution().optimizedPlan().toString()


def test_cuts_of_many_streams_are_those_of_each():
    rng = np.random.default_rng(8)
    sizes = np.concatenate([rng.integers(1, 900, 60), [1, 15, 16, 17, 9000, 64]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, 5000, at[-1])
    ids[2000:9000] = 7
    made = token_store.all_cuts(ids, at)
    assert [x.tolist() for x in made] == [token_store.cuts(ids[a:b]).tolist() for a, b in zip(at[:-1], at[1:])]


def test_chunks_follow_the_content():
    ids = np.random.default_rng(6).integers(0, 5000, 20000)
    ends = token_store.cuts(ids)
    assert ends[-1] == len(ids) and (np.diff(ends, prepend=0) <= token_store.MOST).all()
    moved = token_store.cuts(np.concatenate([ids[:50], [7, 7, 7], ids[50:]]))
    assert len(set((moved - 3).tolist()) & set(ends.tolist())) >= len(ends) - 3
    assert token_store.cuts(np.array([1])).tolist() == [1]


@pytest.mark.parametrize("most_chars, most_conversations", [(chat.MOST_CHARS, chat.MOST_CONVERSATIONS), (60, 2)])
def test_chat(spark, monkeypatch, most_chars, most_conversations):
    monkeypatch.setattr(chat, "MOST_CHARS", most_chars)
    monkeypatch.setattr(chat, "MOST_CONVERSATIONS", most_conversations)
    control = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", "hello ñ"), (1, 1, "assistant", control), (2, 0, "user", "hello ñ"), (2, 1, "assistant", "other # text"), (3, 0, "user", "hello ñ"), (3, 1, "assistant", control), (4, 1, None, None),
             (4, 0, "sys:tem", "\\"), (5, None, "assistant", ""), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (6, 0, "user", "a"), (6, 0, "user", "a")]
    turns += [(100 + i, 0, "user", "hello ñ") for i in range(700)]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, nodes string").repartition(3)
    path = vocabulary("byte_bpe_50k.json")
    made = chat.segments(table, path).cache()
    whole = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            whole[c].append((-1 if t is None else t, r or "", x or ""))
    expected = Counter((c, tuple((r, x) for _, r, x in sorted(ts))) for c, ts in whole.items())
    expected.update([(None, (("user", "alone"),))] * 2)
    read = chat.read_back(made, path).collect()
    assert Counter((r["conv_id"], tuple((t["role"], t["text"]) for t in r["turns"])) for r in read) == expected
    assert all("".join(r["learnt"]) == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant") for r in read)
    tokens = {s["segment_id"]: len(s["ids"]) // 4 for s in made.collect()}
    for segment in made.collect():
        nodes, base = segment["nodes"], sum(a["tokens"] for a in segment["above"])
        assert all(tokens[a["segment_id"]] == a["tokens"] for a in segment["above"])
        for k, n in enumerate(nodes):
            above = nodes[n["parent"]] if n["parent"] >= 0 else None
            # Parents come first, positions go on from them, and attention is theirs and the node's own.
            assert n["parent"] < k and n["position"] == (above["position"] + above["end"] - above["start"] if above else base)
            assert n["attends"] == [*(above["attends"] if above else []), n["attends"][-1]] and tuple(n["attends"][-1]) == (n["start"], n["end"])
        assert [n["start"] for n in nodes[1:]] == [n["end"] for n in nodes[:-1]]
        assert all(m["leaf"] < len(nodes) for m in segment["conversations"])
    # Every turn is emitted once for all conversations that begin so, in however many segments they are.
    beginnings = {tuple(x[1:] for x in sorted(ts)[: k + 1]) for ts in [*whole.values(), [(0, "user", "alone")]] for k in range(len(ts))}
    assert sum(len(s["nodes"]) for s in made.collect()) == len(beginnings) and made.count() >= 2
    assert max(len(s["conversations"]) for s in made.collect()) <= 8 * chat.MOST_CONVERSATIONS
    assert chat.segments(table.limit(0), path).count() == 0


@pytest.mark.parametrize("raw", ["", "\\", "\\\\#", "###", "####", "</turn>", "<\\/turn>", "</turn></turn>\\", "\\### Assistant: </turn> ok"])
def test_escapes(raw):
    assert chat.unescape(chat.escape(raw)) == raw
    assert "###" not in chat.escape(raw) and "</turn>" not in chat.escape(raw)


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])[::-1]
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_pii(spark, docs, rows, none):
    hard = ["é a@b.cc_x@d.ee a@b.c+x@d.e", "007.1.2.300 0.0.0.0 1.2.3.4.5.6.7.8 12.34.56.78.90", "4539-1488 0343 6467 45391488034364670 0000000000000000", "+1 (415) 555-0100 ext +49.30.123456- +1", "x" * 3000 + "@" + "y.z" * 2000, "1" * 4000, "+1" + " " * 3000]
    table = docs.select("doc_id", "text", F.lit("s").alias("spans"), F.lit("c").alias("candidates")).unionByName(spark.createDataFrame([(9000 + i, x, "s", "c") for i, x in enumerate(hard)], "doc_id long, text string, spans string, candidates string"))
    found = pii.find(table).collect()
    wanted = Counter((d, tuple(base_spans(x or ""))) for d, x in [*((r[0], r[1]) for r in rows), *((9000 + i, x) for i, x in enumerate(hard))])
    got = Counter((r["doc_id"], tuple((s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["base"])) for r in found)
    assert got == wanted
    assert pii.find(none).count() == 0
    masked = pii.mask(spark.createDataFrame([("ñ a@b.cc and 1.2.3.4.",), (None,)], "text string"), pii.Model({}, {})).collect()
    assert [r["text"] for r in masked] == ["ñ <email> and <ip>.", None]


def test_added_spans_are_personal_data(spark):
    """Spelt-out addresses and national numbers are added; of the rest only numbers that the word card stands before, checksum or not."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows, planted = [], set()
    for i in range(400):
        kind = i % 5
        lead = ["mail ", "phone ", "", "order ", "card "][kind]
        body = [f"{name()} (at) {name()} (dot) com", number(), f"{name()}@{name()}.org and +1 {number()}", "".join(rng.choice("0123456789") for _ in range(15)), f"4{rng.randint(10**14, 10**15 - 1)}"][kind]
        rows.append((i, f"Some words {lead}{body} end."))
        if kind < 2:
            planted.add(i)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r["doc_id"] for r in found if any(not s["base"] for s in r["spans"])}
    after_card = {i for i in range(400) if i % 5 == 4}
    assert len(added & planted) >= 0.9 * len(planted) and len(added - planted - after_card) <= 0.05 * len(added)


def test_working_columns_of_callers_stay(spark, docs):
    named = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("_words", "_Lines", "_pii_text", "_pii_spans", "_pii_email")))
    for made in (quality.judge(named), quality.clean(named), pii.candidates(named), pii.mask(named, pii.Model({}, {}))):
        assert set(named.columns) <= set(made.columns)
        assert all(set(r) == {1} for r in made.select("_words", "_Lines", "_pii_text", "_pii_spans", "_pii_email").collect())


def test_votes_tell_good_labelers_from_bad():
    patterns = {(1, 1, 1, 1, 1): 400, (0, -1, -1, 0, -1): 300, (1, 1, 1, 0, 1): 100, (0, -1, 1, 0, 1): 40}
    likely = pii.estimate(patterns)
    assert likely[1, 1, 1, 1, 1] > 0.9 > 0.1 > likely[0, -1, -1, 0, -1]
