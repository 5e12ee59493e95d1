import random
import re
import zlib
from collections import Counter

import pytest

from mediatally.llm import spelling as S

from .conftest import odd_rows, table_rows


def counts(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def simple(rows):
    n = counts(rows)
    drops = {}  # words that can be near share what is left when a letter goes
    for w in n:
        for k in range(len(w)):
            drops.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for other in set().union(drops.get(w, ()), *(drops[w[:k] + w[k + 1 :]] for k in range(len(w))), (w[:k] + w[k + 1 :] for k in range(len(w)))):
            if other in n and apart(w, other):
                near[w].add(other)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def found(df, **parameters):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in S.spelling_variants(df, **parameters).collect())


def made_rows():
    """Chains of forms, ties, letters beyond ASCII, very long words, and runs that lose a letter."""
    rng = random.Random(3)
    base = ["harbour", "séparer", "Ünderstood", "aaaaaaa", "x" * 3000, "planet÷s"]
    words = ["gardener"] * 800 + ["gardenor"] * 150 + ["gardonor"] * 25 + ["gardonir"] * 5
    for w in base:
        family, n = [w], 700
        while n >= 5:
            w = rng.choice(family)
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abxyzé") + w[k:], w[:k] + rng.choice("abxyzé") + w[k + 1 :]])
            family.append(w)
            words += [w if rng.random() < 0.8 else w.upper() if w.isascii() else w] * n
            n = n // rng.choice([1, 2, 5, 6])
    rng.shuffle(words)
    return [(i, ", ".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20)]


@pytest.mark.parametrize("parameters", [{}, {"shard_words": 3}, {"shard_words": 1}])
def test_made_words(docs_of, parameters):
    rows = made_rows()
    want = simple(rows)
    assert found(docs_of(rows), **parameters) == want
    assert any(r[1] and r[2] != r[1] for r in want), "a chain of forms"


def test_tables(spark):
    rows = [(r.doc_id, r.text) for r in table_rows(spark, "documents", "sf0.01")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = simple(rows)
    assert len(want) > 5_000 and sum(w[4] for w in want) > 5_000
    assert found(docs, shard_words=500) == want


def test_odd_rows(odd_docs, no_docs, docs_of):
    assert found(odd_docs) == simple([r[:2] for r in odd_rows()])
    repeated = odd_rows() * 5
    assert found(docs_of([r[:2] for r in repeated])) == simple([r[:2] for r in repeated])
    assert found(no_docs) == []
