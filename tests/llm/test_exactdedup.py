import hashlib
import re

from mediatally.llm import exactdedup as E

from .conftest import odd_rows


def simple(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, text or ""))
    out = []
    for bare, own in groups.items():
        order = sorted(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        keep = order[0][0]
        out += [(i, keep, len(own), k == 0, hashlib.sha256(bare.encode()).hexdigest()) for k, (i, _) in enumerate(order)]
    return sorted(out, key=repr)


def found(df, **parameters):
    rows = E.exact_dedup(df, digest_all=True, **parameters).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=repr)


def test_groups_ties_and_hot_group(docs_of):
    rows = [(i, "the hot text" if i % 3 else f"own {i}") for i in range(300)]
    rows += [(900, "the  hot text"), (901, "the \u00a0hot text"), (902, "a b"), (903, "ab"), (904, "a\x0bb"), (905, "x" * 64 + "1"), (906, "x" * 64 + "2")]
    assert found(docs_of(rows)) == simple(rows)
    assert found(docs_of(rows), prefix=1, bits=1 << 15) == simple(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [r[:2] for r in odd_rows()]
    assert found(odd_docs) == simple(rows)
    assert found(no_docs) == []
    left = E.without_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert left.count() == sum(r[3] for r in simple(rows))
    assert E.without_copies(no_docs).count() == 0


def test_plan_has_no_python(odd_docs):
    plan = E.exact_dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
