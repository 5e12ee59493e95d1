"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from the labels: word stems that stand in many toxic and hardly any clean text of a fit sample. The
stems form a trie. A word is read letter by letter through the product of the trie and the automaton of all strings within
a few edits (none for stems under 5 letters, one from 5, two from 9): a state is the set of trie nodes that can be reached,
each with its least number of edits. States and their transitions are made when first met and kept, so most words end
after a few table look-ups in the dead state. A hit counts as plain, or as quoted when the window around it has quotation
marks on both sides or a word that reports speech; a window with a word of address makes it directed. A logistic
regression over these counts, fitted on the same sample, gives the score.

The sample is bounded by FIT_ROWS (the labelled rows with the smallest hash); rows whose crc32(doc_id as text) mod 5 is 0
never teach. Everything a fit sends to the driver is bounded by the sample. Scoring reads each whole text alone, in one
pass without a shuffle; labels, language, source and id are no inputs of a score.

Defined results: a null text counts as empty and gets the score of a text without hits; without labelled rows of both
kinds every score is 0; a doc_id labelled more than once counts as toxic if any label says so, null labels are ignored;
rows that repeat are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import kept_in_worker, small_batches, staged, table, texts

FIT_ROWS = 20_000
STEM = range(4, 11)  # lengths of stems
WINDOW = 60  # characters on each side of a hit
KEPT_WORDS = 120_000  # words whose verdict is kept, and as many of the generation before
KEPT_LENGTH = 64  # longer words hardly repeat and are not kept
KEPT_PARTS = 1_000_000  # trie nodes and steps that the automaton's states may hold before they are made anew
WORD = re.compile(r"[\w@$*]+")
EDGE = "@$*_"
QUOTES = re.compile("[\"“”„«»‹›]|(?<!\\w)['‘]|['’](?!\\w)")
REPORTS = frozenset("said says say wrote writes quote quoted quotes called calling according word term insult sagte schrieb nannte dit écrit dijo escribió llamó".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir dein tu te toi vous usted ustedes ti".split())


def edits_allowed(stem: str) -> int:
    return 0 if len(stem) < 5 else 1 if len(stem) < 9 else 2


class Automaton:
    """Reads a word; finds the least number of edits between one of the stems and a beginning of the word."""

    def __init__(self, stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [0]  # most edits that any stem below the node allows
        self.ends = [-1]  # edits allowed by the stem that ends here
        for stem in stems:
            node, k = 0, edits_allowed(stem)
            self.allowed[0] = max(self.allowed[0], k)
            for letter in stem:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.ends.append(-1)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], k)
            self.ends[node] = k
        self.clear()

    def clear(self) -> None:
        """Forget the states; they are found again as words need them."""
        self.parts = 0
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[int] = []  # least edits of a stem that ends in the state, or NONE
        self.steps: list[dict[str, int]] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    NONE = 9

    def _state(self, reached: dict[int, int]) -> int:
        """The state of these nodes and edits, and of those that leaving letters of the stem out adds."""
        waiting = list(reached)
        while waiting:
            node = waiting.pop()
            more = reached[node] + 1
            for child in self.children[node].values():
                if more <= self.allowed[child] and more < reached.get(child, self.NONE):
                    reached[child] = more
                    waiting.append(child)
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.accepts.append(min((e for n, e in key if e <= self.ends[n]), default=self.NONE))
            self.steps.append({})
            self.parts += len(key)
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def offer(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and edits < reached.get(node, self.NONE):
                reached[node] = edits

        for node, edits in self.members[state]:
            offer(node, edits + 1)  # a letter too many
            for other, child in self.children[node].items():
                offer(child, edits + (other != letter))
        self.steps[state][letter] = found = self._state(reached)
        self.parts += 1
        return found

    def edits(self, word: str) -> int:
        if self.parts > KEPT_PARTS:
            self.clear()
        state, best = self.start, self.NONE
        for letter in word:
            found = self.steps[state].get(letter)
            state = self._step(state, letter) if found is None else found
            if state == self.dead:
                break
            best = min(best, self.accepts[state])
        return best


@dataclass
class Model:
    stems: list[str]
    weights: list[float] = field(default_factory=list)  # intercept first; none: every score is 0


class Scorer:
    """Features and scores of texts; verdicts on words are kept, the older half forgotten when full."""

    def __init__(self, model: Model):
        self.automaton, self.weights = Automaton(model.stems), np.array(model.weights)
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def verdict(self, word: str) -> int:
        if len(word) > KEPT_LENGTH:
            return self.automaton.edits(word.strip(EDGE))
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) >= KEPT_WORDS:
                self.kept, self.older = {}, self.kept
            found = self.older.get(word)
            if found is None:
                found = self.automaton.edits(word.strip(EDGE))
            self.kept[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Whether an exact plain hit is there; log counts of exact plain, near plain, directed, exact quoted and near quoted ones."""
        low = text.lower()
        words = WORD.findall(low)
        hits = {w for w in set(words) if self.verdict(w) < Automaton.NONE}
        n = Counter()
        if hits:
            for m in WORD.finditer(low):
                if m[0] in hits:
                    left, right = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
                    near = {*WORD.findall(left), *WORD.findall(right)}
                    quoted = bool(near & REPORTS) or bool(QUOTES.search(left) and QUOTES.search(right))
                    n["exact" if self.verdict(m[0]) == 0 else "near", quoted] += 1
                    n["directed"] += bool(near & ADDRESS) and not quoted
        counts = [n["exact", False], n["near", False], n["directed"], n["exact", True], n["near", True]]
        return [float(counts[0] > 0), *map(math.log1p, counts)]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def scorer_of(model: Model) -> Scorer:
    """One per worker and model: later tasks of the worker find its tables filled."""
    return kept_in_worker(("toxicity", repr(model)), lambda: Scorer(model))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    scorer = scorer_of(model)
    rows = [scorer.features(t or "") for t in column.to_pylist()]
    return scorer.score(np.array(rows, float).reshape(len(rows), -1)) if rows else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and toxic of at most `rows` labelled documents, exact copies once."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = texts(docs).join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of numbers
    return found.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def stems_of(text: str) -> set[str]:
    words = {w.strip(EDGE) for w in set(WORD.findall(text.lower()))}
    return {w[:n] for w in words for n in STEM if len(w) >= n and w[:n].isalpha()}


def stem_counts(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """In how many texts each stem stands; one row per task and stem is shuffled, more only to keep the task's table small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(stems_of(text) if wanted is None else stems_of(text) & wanted)
                if len(n) > 300_000:
                    yield pa.RecordBatch.from_pydict({"stem": list(n), "n": list(n.values())})
                    n = Counter()
        yield pa.RecordBatch.from_pydict({"stem": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return sample.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def learn_stems(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Stems that mark toxic texts, chosen so that each adds texts the ones before do not cover twice."""
    support = max(3, n_toxic // 400)
    toxic = sample.where("toxic = 1")
    often = {r.stem: r.n for r in stem_counts(toxic, None).where(F.col("n") >= support).collect()}
    clean = {r.stem: r.n for r in stem_counts(sample.where("toxic = 0"), frozenset(often)).collect()}
    # The texts of the kinds differ in number, so a stem counts by its share in each.
    marks = {s: n for s, n in often.items() if n / n_toxic >= 20 * (clean.get(s, 0) + 0.5) / (n_clean + 1) and n >= 9 * clean.get(s, 0)}
    # Of stems that grow out of each other and mark the same texts, the longest.
    longer = {s[:-1] for s, n in marks.items() if n >= 0.95 * marks.get(s[:-1], math.inf)}
    marks = {s: n for s, n in marks.items() if s not in longer}
    names = frozenset(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(stems_of(t) & names) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["stems"])

    held = [r.stems for r in toxic.select("text").mapInArrow(run, "stems array<string>").collect()]
    where = defaultdict(set)
    for i, stems in enumerate(held):
        for s in stems:
            where[s].add(i)
    covered, chosen = Counter(), []
    gains = {s: len(w) for s, w in where.items()}
    while gains:
        best = max(gains, key=lambda s: (gains[s], -len(s), s))
        gain = sum(covered[i] < 2 for i in where[best])
        if gain < gains[best]:  # out of date: put back with what it adds now
            if gain >= support:
                gains[best] = gain
            else:
                del gains[best]
            continue
        del gains[best]
        if any(best.startswith(c) for c in chosen):
            continue
        chosen.append(best)
        covered.update(where[best])
    return sorted(chosen)


TELLING = 4  # the first features are signs of abuse, so they never count against it; quoted hits may


def logistic(features: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Weights by Newton's method; a sign of abuse that would get a negative weight is left out."""
    used = list(range(features.shape[1]))
    while True:
        w = newton(features[:, used], toxic)
        least = min((w[1 + i], i) for i, f in enumerate(used) if f < TELLING) if used and used[0] < TELLING else (0, 0)
        if least[0] >= 0:
            break
        del used[least[1]]
    full = np.zeros(features.shape[1] + 1)
    full[[0, *(1 + f for f in used)]] = w
    return [round(float(v), 6) for v in full]


def newton(features: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    small_batches(docs.sparkSession)
    sample = staged(fit_sample(docs, labels, rows), "toxicity-sample")
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model([])
    lexicon = Model(learn_stems(sample, counts[1], counts[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(lexicon)
        for batch in batches:
            found = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["features", "toxic"])

    found = sample.select("text", "toxic").mapInArrow(run, "features array<double>, toxic int").toPandas()  # at most `rows`
    order = sorted(range(len(found)), key=lambda i: (list(found.features[i]), found.toxic[i]))  # sums in the same order
    x, y = np.array([found.features[i] for i in order]), np.array([found.toxic[i] for i in order])
    return Model(lexicon.stems, logistic(x, y))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, all their columns, whose score is under `least`."""
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at)) < least))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
