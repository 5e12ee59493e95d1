import random

from mediatally.llm import decontaminate as D


def simple_score(item, passage):
    """Smith-Waterman by the textbook."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(200):
        item, passage = ([rng.choice("abcd") for _ in range(rng.randrange(1, 15))] for _ in range(2))
        score, start, end = D.align(item, passage)
        assert score == simple_score(item, passage)
        assert simple_score(item, passage[start:end]) == score


def test_words_and_hashes():
    import re

    texts = ["“Foo” bar—baz Éa_1 x²  日本 ١٢", "", "a", "one two  three"]
    words = D.Words(texts)
    assert words.between(0, 99) == [w for t in texts for w in re.findall(r"\w+", t.lower())]
    again = D.Words(["three two one"])
    assert again.hashes.tolist() == words.hashes[-3:][::-1].tolist()


def make(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(20, "tiny item"), (21, None), (22, ""), (23, "The, of and the")]
    docs, want = [], set()
    filler = lambda n: " ".join(word() for _ in range(n))
    for d in range(60):
        docs.append((d, filler(80)))
    for i in range(20):  # copies with every tenth word changed, and with words left out
        words = items[i][1].split()
        edited = [w if k % 10 else "changed" for k, w in enumerate(words)]
        docs.append((100 + i, f"{filler(20)} {' '.join(edited)} {filler(500)}"))
        docs.append((200 + i, f"{filler(5)}, {' '.join(w for k, w in enumerate(words) if k % 7)}. {filler(5)}".upper()))
        want |= {(100 + i, i), (200 + i, i)}
    docs += [(300, "a tiny item here"), (301, "tiny, but no item"), (302, None), (303, ""), (304, "the of AND the")]
    want |= {(300, 20), (304, 23)}
    docs += [(400 + k, f"{filler(3)} {items[0][1]}") for k in range(200)]  # an item that most documents hold
    want |= {(400 + k, 0) for k in range(200)}
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_finds_edited_copies_and_leaves_clean_texts(spark):
    docs, items, want = make(spark)
    found = D.decontaminate(docs.repartition(3), items, bits=1 << 20).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(0.5 <= r.score <= 1 for r in found)
    # A bitmap that is nearly full costs time, not rows.
    crowded = D.decontaminate(docs, items, bits=1 << 15).collect()
    assert {(r.doc_id, r.item_id) for r in crowded} == want
    left = D.without_leaks(docs, items).collect()
    assert {r.doc_id for r in left} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_every_document_is_counted(spark):
    docs, items, _ = make(spark)
    grams = D.item_grams(items).where("size > 0").collect()
    wanted = {g for r in grams for g in r.grams}
    held = spark.sparkContext.broadcast(D.fetched(D.item_grams(items).selectExpr("explode(grams) as gram"), 1 << 24))
    found = {r.gram: r.n for r in D.document_counts(docs, held, [2]).collect()}
    texts = [set(D.Words([r.text or ""]).grams(2)[0].tolist()) for r in docs.collect()]
    want = {g: sum(g in t for t in texts) for g in wanted}
    assert {g: found.get(g, 0) for g in wanted} == want
    assert max(want.values()) > 200


def all_pairs(docs, items):
    tests = [(i, D.Words([t or ""]).between(0, 10**9)) for i, t in items]
    texts = [(d, D.Words([t or ""]).between(0, 10**9)) for d, t in docs]
    return {(d, i) for d, b in texts for i, a in tests if a and D.align(a, b)[0] >= max(0.5 * len(a), min(2, len(a)))}


def edits(words, rng):
    """Copies that score 0.5 and more without long n-grams: words changed, put in, left out."""
    yield [w if k % 5 != 4 else "changed" for k, w in enumerate(words)]
    yield [w if k % 4 != 3 else "changed" for k, w in enumerate(words)]
    yield [w if k % 4 else f"new{k}" for k, w in enumerate(words)]
    yield [x for k, w in enumerate(words) for x in ([w, "more"] if k % 2 and k + 1 < len(words) else [w])]
    yield [w for k, w in enumerate(words) if k % 4 != 2]
    yield [x for k, w in enumerate(words) if (r := rng.random()) > 0.1 for x in ([w, "in"] if r > 0.9 else ["else"] if r < 0.2 else [w])]


def edited_corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(3))
    filler = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(filler(rng.choice([5, 6, 8, 12, 16, 17, 30, 59])))) for i in range(40)]
    texts = [[*filler(rng.randrange(40)), *copy, *filler(rng.randrange(40))] for _, t in items for copy in edits(t.split(), rng)]
    texts += [filler(100) for _ in range(60)]
    return [(d, " ".join(t)) for d, t in enumerate(texts)], items


def test_edited_copies_as_all_pairs_alignment(spark):
    docs, items = edited_corpus()
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = all_pairs(docs, items)
    assert {(d, d // 6) for d in range(240) if d % 6 in (0, 3)} <= want  # every fifth changed, a word put in after every second
    assert {(r.doc_id, r.item_id) for r in D.decontaminate(df, tests).collect()} == want
    assert {(r.doc_id, r.item_id) for r in D.decontaminate(df, tests, at_once=100).collect()} == want  # in several passes


def test_every_exact_copy_in_the_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    spaced = lambda t: f" {' '.join(D.Words([t or '']).between(0, 10**9))} "
    tests = [(r.item_id, spaced(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in tests if t in spaced(r.text)}
    found = {(r.doc_id, r.item_id) for r in D.decontaminate(docs, items).collect() if r.score == 1}
    assert want and want == found


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "plain prose about nothing at all"), (2, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.decontaminate(odd_docs, items).collect()}
    assert found == {(1, 1), (9, 1)}
    assert D.without_leaks(odd_docs, items).count() == 12
    assert D.without_leaks(odd_docs, items).columns == odd_docs.columns
    assert D.decontaminate(no_docs, items).count() == 0
    assert D.without_leaks(odd_docs, items.where("false")).count() == 14


def test_edited_copies_beside_many_exact_ones(spark):
    """What is found does not depend on how often an item stands in the corpus."""
    rng = random.Random(5)
    item = [f"w{k}" for k in range(16)]
    edited = [w if k not in (5, 11) else "changed" for k, w in enumerate(item)]
    for copies in (0, 1001):
        docs = [(0, " ".join(["before", *edited, "after"]))]
        docs += [(1 + c, f"{rng.random()} {' '.join(item)} {rng.random()}") for c in range(copies)]
        found = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
        assert {r.doc_id: r.score for r in found} == {0: 0.75, **{1 + c: 1.0 for c in range(copies)}}


def test_one_rule_for_items_of_every_length(spark):
    """Items of one to six words against alignment of all pairs; half of a short item counts, one word of several does not."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * 2
    items = [(i, " ".join(word() for _ in range(1 + i % 6))) for i in range(36)]
    docs = [(d, " ".join(word() for _ in range(rng.randrange(1, 40)))) for d in range(120)]
    docs += [(200 + i, f"zz {t.rsplit(' ', 1)[0]} other") for i, t in items]
    items += [(100, "alpha beta gamma delta"), (101, "tiny item"), (102, "alpha alpha alpha")]
    docs += [(300, "so alpha beta gamma other"), (301, "tiny, but no item"), (302, "a tiny item"), (303, "alpha alpha"), (304, "alpha")]
    want = all_pairs(docs, items)
    assert {(300, 100), (302, 101), (303, 102)} <= want and not {(301, 101), (304, 102), (304, 100)} & want
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.decontaminate(*frames).collect()} == want
