import re

from pyspark.sql import functions as F

from mediatally.llm import pii as P

from .conftest import odd_rows, table_rows


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def n_digits(text):
    return len(re.sub("[^0-9]", "", text))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= n_digits(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m) <= 15),
]


def simple(text):
    return [(k, m.start(), m.end()) for k, pattern, ok in BASE for m in re.finditer(pattern, text or "") if ok(m[0])]


def spans(rows):
    return {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.base) for r in rows}


def test_base_spans_on_hard_and_long_texts(docs_of):
    texts = [
        "a@b.c_d@e.f x@y", "a@b a@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", " 4111 1111 1111 1111-4111-1111-1111-1111", "+1 (017) 555-7713 +49 30 123456 +1 5 ++12 34567890-",
        "😀 a.b@c.d 😀 12.13.14.15", "9" * 100_000, "a@b" + ".c" * 15_000, "1 " * 30_000, "+1" + " " * 50_000, "a." * 30_000, "x@y.z " * 1500, None, "", "a%b+c@d-e.f-g.h@i.j",
        "1.1.1.1" * 50, "1 " * 300 + "4111111111111111",
    ]
    found = spans(P.found_spans(docs_of(list(enumerate(texts)))).collect())
    assert found == {i: sorted(simple(t)) for i, t in enumerate(texts)}


def test_base_spans_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = spans(P.personal_data(docs).collect())
    assert found == {r.doc_id: sorted(simple(r.text)) for r in table_rows(spark, "documents", "sf0.01")}


def test_query_lists_spans_by_kind_then_start(spark):
    row = spark.createDataFrame([([("phone", 1, 9), ("email", 50, 60), ("email", 9, 20), ("card", 0, 3)],)], "s array<struct<kind: string, start: int, end: int>>")
    assert row.select(P.listed(F.col("s"))).first()[0] == "email:9:20,email:50:60,card:0:3,phone:1:9"


def test_trees_add_what_looks_like_the_confirmed(docs_of):
    """Numbers in the same context and format are added, others are not, and base spans stay."""
    rows = [(i, f"Order {i}. Please call phone +1 (212) 555-{1000 + i} before noon. Version 1.2.{i}.4 part 12-{1000 + i} of list.") for i in range(400)]
    found = P.personal_data(docs_of(rows), support=5).collect()
    assert spans(found) == {i: sorted(simple(t)) for i, t in rows}
    texts = dict(rows)
    assert all("555" not in texts[r.doc_id][s.start : s.end] for r in found for s in r.added)  # taken by a base span


def test_trees_add_other_ways_to_write_the_same(docs_of):
    """Spelled-out mails, numbers without country code, blanks and other separators are added, what only looks alike is not."""
    card = lambda i: next(c for c in (f"41{i:04d}000000000{d}" for d in range(10)) if luhn(c))
    four = lambda digits, sep: sep.join(digits[k : k + 4] for k in range(0, 16, 4))
    bad = lambda i: card(i)[:-1] + str((int(card(i)[-1]) + 1) % 10)
    plain = [
        (i, f"Please call phone +1 (212) 555-{1000 + i} or mail jane{i}@mail.org now. Part 12-{1000 + i} of list, version 1.2.{i % 250}.4 of server 10.2.{i % 250}.7 took card {four(card(i), ' ')} here. Batch {bad(i + 400)} went.")
        for i in range(400)
    ]
    hard = [
        ("Please call phone (212) 555-1234 or", "phone", "(212) 555-1234"), ("Please call phone 0212 555 1234 or", "phone", "0212 555 1234"),
        ("or mail jane (at) mail (dot) org now.", "email", "jane (at) mail (dot) org"), ("or mail jane at mail dot org now.", "email", "jane at mail dot org"),
        ("of server 10 . 2 . 33 . 7 took", "ip", "10 . 2 . 33 . 7"),
        (f"took card {four(card(3), '.')} here.", "card", four(card(3), ".")), (f"took card {four(card(4), '/')} here.", "card", four(card(4), "/")),
    ]
    others = ["we look at mail dot org now.", "version 1 . 2 . 3 . 4 of", "Part 12-1234 of list", "server 10 . 2 . 333 . 7", f"took card {four(bad(3), '.')} here.", "from 1990-1995 in", "sold for $212 555 1234"]
    rows = plain + [(1000 + k, t) for k, (t, _, _) in enumerate(hard)] + [(2000 + k, t) for k, t in enumerate(others)]
    found = P.personal_data(docs_of(rows)).collect()
    texts = dict(rows)
    assert {(r.doc_id, s.kind, texts[r.doc_id][s.start : s.end]) for r in found for s in r.added} == {(1000 + k, kind, want) for k, (_, kind, want) in enumerate(hard)}
    assert spans(found) == {i: sorted(simple(t)) for i, t in rows}


def test_odd_rows(odd_docs, no_docs):
    found = P.personal_data(odd_docs).collect()
    assert len(found) == len(odd_rows()) and sum(len(r.base) for r in found) == sum(len(simple(r[1])) for r in odd_rows())
    assert P.personal_data(no_docs).count() == 0


def test_plan_has_no_python(odd_docs):
    plan = P.found_spans(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("regexp_extract_all") <= 2 * 8  # each pattern once, named again in the plan's details


def test_candidates_do_not_depend_on_other_text(docs_of):
    texts = ["please write to jane at mail.org today", "please write to jane at mail.org today or a@b.com", "jane at mail[dot]org", "jane at mail dot org", "jane at home",
             "7536784127813050 4845168114407329"]
    found = P.found_spans(docs_of(list(enumerate(texts)))).collect()
    values = {r.doc_id: [(c.kind, c.value) for c in r.candidates if c.kind in ("email", "card")] for r in found}
    assert values[0] == [("email", "jane at mail.org")] and values[1] == [("email", "jane at mail.org"), ("email", "a@b.com")]
    assert values[2] == [("email", "jane at mail[dot]org")] and values[3] == [("email", "jane at mail dot org")] and values[4] == []
    assert values[5] == [("card", "7536784127813050"), ("card", "4845168114407329")]  # numbers side by side
