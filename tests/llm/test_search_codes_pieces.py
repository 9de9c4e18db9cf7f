"""Ranked search, vector codes and SentencePiece ids on odd rows, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from leadloom.llm import pieces, ranked_search, vector_codes
from leadloom.llm.tokenize import vocabulary

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
MODEL = vocabulary("piece_bpe_32k.model")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(rows, items, k):
    """What the search must give, item by item, by scoring all documents."""
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    df, total = Counter(t for _, c, _ in docs for t in c), sum(n for *_, n in docs)
    out = []
    for item, text in items:
        found = []
        for d, c, n in docs:
            m = 75 + 25 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block, k", [(1 << 20, 20), (200, 3), (200, 1)])
def test_search_is_that_of_all_scores(spark, docs, rows, monkeypatch, block, k):
    """Small blocks, a small shard that takes several passes, ties of equal texts, null ids, repeated items."""
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 3000 if k == 3 else 8 << 20)
    items = [(1, rows[0][1]), (1, rows[0][1]), (2, "two WORDS x, again again"), (3, None), (4, ""), (5, "..."), (None, rows[21][1][:900]), (6, "nothing-of-this qqqqqqq"), (7, "a b c d e 10 20 ÉÉ")]
    table = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, rank string, query int")
    got = ranked_search.search(docs.withColumnsRenamed({"a": "query", "key": "rank"}), table, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked([(r[0], r[1]) for r in rows], items, k)


def test_search_without_rows(spark, docs, none):
    items = spark.createDataFrame([("i", "one two")], "item_id string, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert {r["item_id"] for r in ranked_search.search(docs, items).collect()} == {"i"}


def test_bounds_hold_the_score_between_them(spark, docs):
    asked = ranked_search.parsed(["one two words again a b"])
    raw = ranked_search.postings(docs, asked.terms).cache()
    n_docs, n_terms = raw.selectExpr("sum(n_docs)", "sum(n_terms)").first()
    known = ranked_search.weighted(asked, ranked_search.document_frequencies(raw, len(asked.terms)), n_docs)
    seen = 0
    for row in map(lambda r: r.asDict(), ranked_search.index(raw, n_docs, n_terms).collect()):
        block = ranked_search.Block(row, known.terms)
        lower, upper = block.bounds(*known.of(0))
        scores = block.scores(row, *known.of(0), list(range(block.n)))
        assert (lower <= scores).all() and (scores <= upper).all()
        seen += int((scores > 0).sum())
    assert seen > 5


def quantised(rows, entries, rounds):
    """Codes, errors and final entries by plain Python."""
    kept = [(k, [math.floor(4096 * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v in first] for p in range(8)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            members = [[] for _ in books[p]]
            for _, v in kept:
                members[nearest(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(members, books[p])]
    out = []
    for k, v in kept:
        found = [nearest(v, p) for p in range(8)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, books


def test_vector_codes(spark, monkeypatch):
    """Null, non-finite and repeated vectors, ties, null keys and labels, blocks of few rows, clashing columns."""
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    rng = random.Random(4)
    vectors = [[round(rng.gauss(i % 5, 0.7) * 256) / 256 for _ in range(16)] for i in range(90)]
    rows = list(enumerate(vectors)) + [(3, vectors[3]), (None, vectors[5]), (200, None), (201, [None] + vectors[0][1:]), (202, [float("nan")] + vectors[0][1:]), (203, [float("-inf")] + vectors[0][1:]), (204, [0.0] * 16), (205, [0.0] * 16)]
    table = spark.createDataFrame([(k, v, None if i % 4 == 0 else i % 3, "c", 5) for i, (k, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, code string, label_error int").repartition(5)
    codes, books = vector_codes.compress(table)
    got = vector_codes.with_label_error(codes)
    expected, entries = quantised(rows, 16, 6)
    assert books.entries.tolist() == entries
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got.collect()) == Counter(expected)
    errors = Counter()
    for r in got.collect():
        errors[r["label"]] += r["error"]
    assert all(r["label_error_"] == errors[r["label"]] and r["code_"] == "c" and r["label_error"] == 5 for r in got.collect())


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(2, [1.0] * 8), (1, [0.5] * 8)], "vec_id long, embedding array<float>")
    codes, books = vector_codes.compress(few)
    assert {(r["vec_id"], r["code"], r["error"]) for r in codes.collect()} == {(1, "00" * 8, 0), (2, "01" * 8, 0)} and books.entries.shape == (8, 2, 1)
    codes, books = vector_codes.compress(few.filter("vec_id > 9"))
    assert codes.count() == 0 and books is None
    with pytest.raises(Exception, match="one length"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 16)], "vec_id long, embedding array<float>"))


def test_ids_are_those_of_the_library(spark, docs, rows, none):
    library = pieces.model(MODEL).library
    rng = random.Random(9)
    odd = ["".join(rng.choice("ab e.,\n▁é漢1💥\t'<s>") for _ in range(rng.randint(1, 80))) for _ in range(300)] + ["漢字かな交じり文。" * 800, " " * 3000, "\x00", "http://www.example.com/a?b=c"]
    table = docs.withColumnRenamed("key", "ids").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    got = pieces.decode(pieces.encode(table, MODEL), MODEL, "kept").select("doc_id", "text", "ids", "kept").collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") and r["kept"] == library.decode(r["ids"])
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).count() == 0


def test_a_wrong_id_stops_the_job():
    own = pieces.model(MODEL)
    words = ["▁therefore", "\n", "x"]
    own.check(words, [own.merged(w) for w in words])
    for i in range(3):
        with pytest.raises(RuntimeError):
            own.check(words, [own.merged(w) + [5] * (i == k) for k, w in enumerate(words)])
