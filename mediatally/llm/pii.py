r"""Personal data: fixed formats, and candidates that boosted trees judge.

Fixed formats (email, IP address, payment card, phone) are found by pattern and by check (parts, Luhn sum, digits). Then
generators with wide patterns propose more spans of the same kinds, which may overlap each other and the fixed ones:
written-out addresses, numbers with other separators or without a country code, dotted numbers with blanks. Gradient
boosted trees judge each candidate by its shape (length, digits, groups) and its context (words and signs before and after it).
They learn from the candidates whose sort is known: one that a fixed format confirms is an example of personal data; one
that fails its check (sound()), is another kind's fixed span, or stands behind "version" or by a price or a unit is not.
What tells a fixed format from a looser way to write the same (@, country code, the sort of separator, blanks, brackets) is
taken out before the trees see it, so they cannot learn the format itself. For each kind the lowest score at which held-out
candidates of known sort reach the wanted precision is the threshold; a kind that never reaches it adds nothing. Of the
other candidates, which overlap no fixed span, those with that score are added, unless they overlap one of a kind that
stands earlier in KINDS.

Everything is DataFrame and SQL functions, and Spark's own tree learner. Texts are read by one scan; what is kept of them
is a narrow table of spans. Offsets come from the lengths of matches and of the stretches between them, summed in blocks,
so a text with very many matches takes time in proportion. The trees are fitted on at most FIT_ROWS candidates (those with
the smallest hash); thresholds and selection cover all candidates.

Defined results: a null text counts as empty and has no spans; offsets count code points, ends are exclusive; rows that
repeat are searched each; without candidates of both sorts nothing is added; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatally.llm.common import staged, table, texts

FIT_ROWS = 20_000
CONTEXT = 32  # characters on each side of a candidate
BLOCK = 256

KINDS = ("email", "ip", "card", "phone")

# The formats of the contract. A match can only begin where a run of its first characters does or where the
# last match ended, which is said here so that long runs take time in proportion; the loops never give back.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\.\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,5}+\)?[\x20./-][0-9]{3,5}+(?:[\x20.-][0-9]{2,5}+){0,3}+(?![0-9])",
}
PRICE = r"[$€£]"
WEBSITE = r"(?i)^(?:look|looked|looking|see|seen|found|find|is|are|was|were|be|available|online|hosted|live|visit|us|me|here|site|page|more|read|shop|works?|starts?|meet)\x20at\x20"
CUES = {
    "email": r"(?i)mail|contact|write to|reach",
    "ip": r"(?i)\bip\b|addr|host|server|login from",
    "card": r"(?i)card|visa|master|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax|dial|whatsapp",
}


def matches(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """The matches of a pattern, and the stretches between them (one more)."""
    none = F.array().cast("array<string>")
    return (
        F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        F.when(when, F.split(text, pattern, -1)).otherwise(none),
    )


def located(kind: str, found: str, between: str) -> Column:
    """Matches as spans with their text and surroundings. `found`, `between`: columns from matches()."""
    lengths = f"zip_with({found}, slice({between}, 1, size({found})), (m, g) -> length(m) + length(g))"
    blocks = f"transform(sequence(0, (size({found}) - 1) div {BLOCK}), b -> aggregate(slice({lengths}, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0, (a, x) -> a + x))"
    before = f"aggregate(slice(blocks, 1, cast(i div {BLOCK} as int)), 0, (a, x) -> a + x) + aggregate(slice(lengths, cast(i div {BLOCK} * {BLOCK} + 1 as int), cast(i % {BLOCK} as int)), 0, (a, x) -> a + x)"
    # The sums are named by a one-element array, so that each is made once.
    spans = f"""flatten(transform(array(struct({lengths} as lengths, {blocks} as blocks)), s -> transform({found}, (m, i) -> struct(
        '{kind}' as kind,
        {before.replace("blocks", "s.blocks").replace("lengths", "s.lengths")} + length({between}[i]) as start,
        m as value, right({between}[i], {CONTEXT}) as left, left({between}[i + 1], {CONTEXT}) as right))))"""
    empty = "cast(array() as array<struct<kind: string, start: int, value: string, left: string, right: string>>)"
    return F.expr(f"case when size({found}) > 0 then {spans} else {empty} end")


def checked(kind: str, value: Column) -> Column:
    """Whether a match of the format passes its check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: checked(kind, s["value"]))


def with_end(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right")))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, base (checked spans of the fixed formats) and candidates, from one scan; no text is kept."""
    text = F.col("text")
    at, digits = F.contains(text, F.lit("@")), text.rlike("[0-9][^A-Za-z]*[0-9]")
    spelt = at | text.rlike(r"[(\[](?:at|AT)[)\]]|\x20at\x20[A-Za-z0-9-]+(?:\.|\x20?[(\[](?:dot|DOT)[)\]]|\x20dot\x20)")  # what any match holds
    when = {"email": at, "ip": digits, "card": digits, "phone": digits}
    parts = {}
    for k in KINDS:
        parts[f"f_{k}"], parts[f"fb_{k}"] = matches(text, FORMATS[k], when[k])
        parts[f"g_{k}"], parts[f"gb_{k}"] = matches(text, GENERATORS[k], spelt if k == "email" else when[k])
    rows = texts(docs).select("doc_id", *(c.alias(n) for n, c in parts.items()))
    base = F.concat(*(passing(k, located(k, f"f_{k}", f"fb_{k}")) for k in KINDS))
    candidates = F.concat(*(located(k, f"g_{k}", f"gb_{k}") for k in KINDS))
    rows = rows.select("doc_id", with_end(base).alias("base"), with_end(candidates).alias("candidates"))
    return rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"), "candidates",
    )


def plain(kind: str, value: Column) -> Column:
    """A match without the marks that tell the fixed format from others."""
    if kind == "email":
        value = F.regexp_replace(value, r"\x20?[(\[](?:at|AT)[)\]]\x20?|\x20at\x20", "@")
        return F.regexp_replace(value, r"\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20dot\x20", ".")
    if kind == "ip":
        return F.regexp_replace(value, r"\x20", "")
    value = F.regexp_replace(value, "[^0-9]+", "-")
    return F.regexp_replace(value, "^-?(?:00[0-9]{1,3}-)?0*", "") if kind == "phone" else value


def sound(kind: str, value: Column) -> Column:
    """Whether a candidate passes the check of its kind, however it is written."""
    simple = plain(kind, value)
    if kind == "email":
        return simple.rlike(r"^[^@]*[A-Za-z][^@]*@.*\.[A-Za-z]{2,}$") & ~value.rlike(WEBSITE)
    if kind == "phone":  # neither a span of years nor a number in thousands
        years, thousands = r"^(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}$", r"(?:-000)+$"
        return F.length(F.regexp_replace(simple, "-", "")).between(7, 14) & ~simple.rlike(years) & ~simple.rlike(thousands)
    return checked(kind, simple)


def by_kind(make) -> Column:
    return F.coalesce(*(F.when(F.col("c.kind") == k, make(k)) for k in KINDS))


def features(candidates: DataFrame) -> DataFrame:
    """Shape and context of each candidate as numbers; `taken` by a fixed format; `label`: 1, 0, or null if not known."""
    right = F.col("c.right")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    overlap = lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"])
    # A country code before the match is a mark of the fixed format.
    left = F.when(F.col("c.kind") == "phone", F.regexp_replace("c.left", r"\+[0-9]{0,3}[\x20.(-]*$", "")).otherwise(F.col("c.left"))
    rows = candidates.select(
        "row", "c", by_kind(lambda k: plain(k, F.col("c.value"))).alias("value"), left.alias("left"),
        F.coalesce(by_kind(lambda k: sound(k, F.col("c.value"))), F.lit(False)).alias("sound"),
        F.exists("base", lambda s: overlap(s) & (s["kind"] == F.col("c.kind"))).alias("confirmed"),
        F.exists("base", overlap).alias("taken"),
    )
    value, left = F.col("value"), F.col("left")
    columns = {
        **{f"is_{k}": yes(F.col("c.kind") == k) for k in KINDS},
        "length": F.length(value).cast("double"),
        "digits": count(value, "[0-9]"), "groups": count(value, "[0-9]+"), "longest": F.array_max(F.transform(F.split(value, "[^0-9]+"), F.length)).cast("double"),
        "dots": count(value, r"\."), "hyphens": count(value, "-"),
        "first": F.coalesce(F.regexp_extract(value, "[0-9]", 0).try_cast("double"), F.lit(-1.0)),
        "after_letter": yes(left.rlike(r"[\p{L}_]$")), "after_digit": yes(left.rlike(r"[0-9][\x20.,:-]*$")),
        "after_colon": yes(left.rlike(r"[:=]\s*[\"']?$")), "before_letter": yes(right.rlike(r"^[\p{L}_]")), "before_digit": yes(right.rlike(r"^[\x20.,:-]*[0-9]")),
        "before_unit": yes(right.rlike(rf"^\x20?(?:%|{PRICE}(?!{PRICE})|(?:k|M|G)?B\b|px\b|ms\b)")), "after_price": yes(left.rlike(rf"(?<!{PRICE}){PRICE}\x20?$")),
        "cue": by_kind(lambda k: yes(left.rlike(CUES[k]))),
        "version": yes(left.rlike(r"(?i)(?:version|release|\bv)\.?\s*$")),
    }
    rows = rows.select("row", "c", "sound", "confirmed", "taken", *(c.alias(f"x_{n}") for n, c in columns.items()))
    label = (
        F.when(F.col("x_before_unit") + F.col("x_after_price") + F.col("x_version") > 0, 0.0)
        .when(F.col("confirmed"), F.when(F.col("sound"), 1.0)).when(F.col("taken") | ~F.col("sound"), 0.0)
    )
    return rows.withColumn("label", label).drop("sound", "confirmed")


def fit(rows: DataFrame, fit_rows: int, trees: int, depth: int):
    """Boosted trees over a bounded sample of candidates of known sort; None if they are all of one sort."""
    chosen = staged(rows.where("label is not null").orderBy(F.xxhash64("row", "c.start", "c.kind"), "row", "c.start").limit(fit_rows), "pii-sample")
    sorts = chosen.groupBy("label").count().collect()  # two rows at most
    if len(sorts) < 2:
        return None
    names = [n for n in chosen.columns if n.startswith("x_")]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(chosen).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(ready)


def thresholds(scored: DataFrame, precision: float, support: int) -> dict[str, float]:
    """For each kind the lowest score that held-out candidates of known sort show to reach the precision at and above it."""
    counts = (
        scored.where("held_out and label is not null").groupBy(F.col("c.kind").alias("kind"), F.floor(F.col("score") * 100).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("right")).collect()  # 404 rows at most
    )
    found = {}
    for kind in KINDS:
        n = right = 0
        for row in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.bin):
            n, right = n + row.n, right + row.right
            if n >= support and right >= precision * n:
                found[kind] = row.bin / 100
    return found


def first_kinds(spans: DataFrame) -> DataFrame:
    """The spans (row, kind, start, end) that overlap none of a kind that stands earlier in KINDS."""
    order = Window.partitionBy("row").orderBy("start", "end")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    place = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    clash = F.lit(False)
    for i, k in enumerate(KINDS[:-1], 1):
        ends, starts = (F.when(F.col("kind") == k, F.col(c)) for c in ("end", "start"))
        meets = (F.max(ends).over(before) > F.col("start")) | (F.min(starts).over(behind) < F.col("end"))
        clash = clash | ((place > i) & F.coalesce(meets, F.lit(False)))
    return spans.withColumn("clash", clash).where("not clash").drop("clash")


def personal_data(docs: DataFrame, precision: float = 0.95, support: int = 20, fit_rows: int = FIT_ROWS, trees: int = 12, depth: int = 4) -> DataFrame:
    """One row per document: doc_id, base (spans of the fixed formats), added (chosen candidates)."""
    rows = staged(found_spans(docs), "pii-spans")
    exploded = rows.where(F.size("candidates") > 0).select("row", "base", F.explode("candidates").alias("c"))
    judged = staged(features(exploded), "pii-candidates")
    held = (F.pmod(F.xxhash64("row"), F.lit(5)) == 0).alias("held_out")
    model = fit(judged.where(~held), fit_rows, trees, depth)
    kind = "array<struct<kind: string, start: int, end: int>>"
    if model is None:
        return rows.select("doc_id", "base", F.array().cast(kind).alias("added"))
    ready = VectorAssembler(inputCols=[n for n in judged.columns if n.startswith("x_")], outputCol="features").transform(judged)
    scored = model.transform(ready).select("row", "c.kind", "c.start", "c.end", "c", "label", "taken", held, vector_to_array("probability")[1].alias("score"))
    least = thresholds(scored, precision, support)
    if not least:
        return rows.select("doc_id", "base", F.array().cast(kind).alias("added"))
    enough = F.coalesce(*(F.when(F.col("kind") == k, F.col("score") >= v) for k, v in least.items()), F.lit(False))
    added = first_kinds(scored.where(enough & F.col("label").isNull() & ~F.col("taken")).select("row", "kind", "start", "end")).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return rows.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(kind)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    place = F.transform(spans, lambda s: F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(place), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
