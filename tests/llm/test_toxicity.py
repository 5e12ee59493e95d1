import random
import zlib

from mediatally.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def distance(stem, word):
    """Edits between a stem and the best beginning of a word."""
    row = list(range(len(word) + 1))
    for i, a in enumerate(stem, 1):
        new = [i]
        for j, b in enumerate(word, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_automaton_against_edit_distance():
    rng = random.Random(3)
    stems = ["abca", "abcab", "ccabb", "bacabacab", "aaaaaaaaa", "cab"]
    automaton = T.Automaton(stems)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        near = [d for s in stems if (d := distance(s, word)) <= T.edits_allowed(s)]
        assert automaton.edits(word) == min(near, default=T.Automaton.NONE), word


def test_tables_of_a_worker_are_bounded(monkeypatch):
    """States that are made anew give the same edits, and long words are not kept."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11))) for _ in range(40)]
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    want = [T.Automaton(stems).edits(w) for w in words[:50]] + [*map(T.Automaton(stems).edits, words[50:])]
    monkeypatch.setattr(T, "KEPT_PARTS", 200)
    automaton, most = T.Automaton(stems), 0
    for word, edits in zip(words, want):
        assert automaton.edits(word) == edits
        most = max(most, automaton.parts)
    assert most < 5_000
    scorer = T.Scorer(T.Model(stems, [0.0] * 7))
    scorer.features(" ".join(w * 40 for w in words))
    assert not any(len(w) > T.KEPT_LENGTH for w in scorer.kept)


def test_quotation_and_address():
    scorer = T.Scorer(T.Model(["idiot"], [0.0] * 7))
    plain, quoted, near = (scorer.features(t) for t in ("you are an idiot", 'he said "idiot" once', "what an id1ot"))
    assert plain[0] == 1 and plain[1] > 0 and plain[3] > 0 and plain[4] == 0
    assert quoted[0] == 0 and quoted[1] == 0 and quoted[4] > 0
    assert near[0] == 0 and near[2] > 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = T.op6_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([r for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_held_out_labels_teach_nothing(spark, docs_of):
    docs = docs_of([(i, f"awful vermin here {i}" if i % 2 else f"fine prose here {i}") for i in range(200)])
    rows = [(i, i % 2) for i in range(200)]
    wrong = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in rows]
    models = [T.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (rows, wrong)]
    assert models[0] == models[1] and any(s.startswith("awf") or s.startswith("verm") for s in models[0].stems)


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(odd_docs, none)
    assert {r.score for r in T.toxicity_scores(odd_docs, model).collect()} == {0.0}
    labels = spark.createDataFrame([(i, k) for i in range(1, 12) for k in (None, int(i == 7))] + [(None, 1), (99, 1)], "doc_id long, toxic int")
    model = T.fit(odd_docs, labels)
    assert T.toxicity_scores(odd_docs, model).count() == 14
    left = T.without_toxic(odd_docs, model)
    assert left.columns == odd_docs.columns and left.count() <= 14
    assert T.toxicity_scores(no_docs, model).count() == 0 and T.fit(no_docs, labels).weights == []
