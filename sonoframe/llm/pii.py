"""Personal data in texts: spans that fixed rules find, and more that boosted trees choose among proposed ones.

The rules find e-mail and IP addresses, card and phone numbers. Generators propose spans more freely, also
overlapping ones; each is described by a few small numbers of its format and context. The trees learn which
descriptions are those of spans that the rules confirm, without seeing the marks that the rules ask for, so they
also choose spans that are written otherwise: numbers that stand too near to others, addresses with "(at)".
A kind's threshold is the least score whose choices are right as often as ``PRECISION`` on texts held out.

Everything over the texts is made of SQL functions. Since descriptions are small numbers, all candidates of the
corpus collapse to counted cells (at most ``CELLS`` of them, however large the corpus), and only those are boosted
on the driver. Places are code points, from 0, ends exclusive. A null text is an empty one; a corpus without
confirmed spans adds nothing to the rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import wrapped

KINDS = ("email", "ip", "card", "phone")
#: The rules, written so that a search looks at each character a bounded number of times: no repeats inside a run
#: are tried again, runs are entered where they begin or where the last match ended, and rare characters come first.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds if the rule can match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Candidates by kind: at most a few hundred characters, bounded by what can't belong to them.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20?@\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"[0-9](?<![0-9.][0-9])[0-9]{0,2}(?:\x20?[.]\x20?[0-9]{1,3}){3}(?![.]?[0-9])",
    "card": r"[0-9](?<![0-9.][0-9])[0-9]{3}(?:(?:[\x20._-]{0,2}[0-9]{4}){2}[\x20._-]{0,2}[0-9]{1,4}|[\x20._-]{0,2}[0-9]{6}[\x20._-]{0,2}[0-9]{5})(?![0-9.])",
    "phone": r"[+(0-9](?<![0-9.][+(0-9])(?:(?<=[+])[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}|(?<=[(])[0-9]{2,4}|(?<=[0-9])(?:[0-9]{0,2}[\x20.-]\(?[0-9]{2,4}|[0-9]{1,3}))\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.])",
}
GENERATORS_NEED = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\x20?\.\x20?[0-9]", "card": "[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{3}"}
#: Words that stand before personal data, by kind.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|address|reach)\b",
    "ip": r"(?i)\b(ip|host|server|address|client|from)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay(ment)?)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|dial|contact)\b",
}
#: Characters before a candidate in which context words count.
BEFORE = 40
#: Features, with how many values each has.
FEATURES = {"kind": 4, "digits": 7, "marks": 4, "shape": 3, "before": 4, "after": 4, "context": 2, "valid": 2}
CELLS = math.prod(FEATURES.values())
TREES, DEPTH, RATE, LEAST_WEIGHT = 30, 3, 0.3, 5.0
PRECISION, SUPPORT, CALIBRATION_FOLDS = 0.98, 10, 4
SPAN = "array<struct<start:int,end:int,text:string>>"
BLOCK = 64


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """``df`` with a column of spans for each pattern: its matches from the left, none overlapping; none in texts that hold no match of ``needs``.

    Places are sums of the lengths of matches and of what lies between them. The sums go by blocks, so that long
    arrays aren't copied once an entry; each step is a column of its own, so that none is computed once an entry.
    """
    zero, nothing = F.lit(0), F.array().cast("array<string>")
    steps: list[dict[str, Column]] = [{} for _ in range(6)]
    for name, pattern in patterns.items():
        hits, gaps, sizes, blocks, starts = (f"_{step}_{name}" for step in ("hits", "gaps", "sizes", "blocks", "starts"))
        steps[0][hits] = F.when(F.col(text).rlike(needs[name]), F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(nothing)
        steps[1][gaps] = F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(nothing)
        steps[2][sizes] = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.col(hits), lambda g, h: F.length(g) + F.length(h))
        n_blocks = F.floor((F.size(sizes) + BLOCK - 1) / BLOCK).cast("int")
        places = F.when(n_blocks > 0, F.sequence(zero, n_blocks - 1)).otherwise(F.array().cast("array<int>"))
        steps[3][blocks] = F.transform(places, cut_of(sizes))
        sums = F.aggregate(blocks, F.array(zero), lambda done, block: F.concat(done, F.array(F.element_at(done, -1) + F.aggregate(block, zero, lambda a, x: a + x))))
        steps[4][starts] = F.slice(sums, 1, F.size(blocks))
        ends = F.flatten(F.zip_with(blocks, starts, lambda block, s: F.transform(block, lambda _, i: s + F.aggregate(F.slice(block, F.lit(1), i + 1), zero, lambda a, x: a + x))))
        steps[5][name] = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text"))).cast(SPAN)
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*[name for step in steps[:5] for name in step])


def cut_of(sizes: str):
    return lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` have a right check digit."""
    back = F.reverse(digits_of(text))
    once, twice = F.regexp_replace(back, "(.)(.)?", "$1"), F.regexp_replace(back, "(.)(.)?", "$2")
    digits = F.regexp_extract_all(F.concat(once, F.translate(twice, "0123456789", "0246813579")), F.lit("[0-9]"), 0)
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x.cast("int")) % 10 == 0


def within_255(text: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return text.rlike(rf"^{part}(?:\.{part}){{3}}$")


def confirmed(kind: str, text: Column) -> Column:
    """Whether a match of the kind's rule is one: what the pattern alone doesn't say."""
    if kind == "ip":
        return within_255(text)
    if kind == "card":
        return luhn(text)
    if kind == "phone":
        return F.length(digits_of(text)).between(8, 15)
    return F.lit(True)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the confirmed spans of each kind in columns of its name."""
    df = with_spans(df, text, RULES, NEEDS)

    def fine(kind: str):
        return lambda s: confirmed(kind, s["text"])

    return df.withColumns({k: F.filter(k, fine(k)) for k in KINDS})


def char_class(c: Column) -> Column:
    """0 for nothing or white space, 1 for letters and digits, 2 for quotes and signs of code or money, 3 for others."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}_]"), 1).when(c.rlike(r"^[\"'=#$%&@/\\<>{}|]"), 2).otherwise(3)


def features(kind: str, text: Column, left: Column, right: Column) -> list[Column]:
    """What the trees see of a candidate: not the sign that its rule asks for, such as a plus before a phone number."""
    digits = F.length(digits_of(text))
    numbers = F.when(digits == 0, 0).when(digits < 7, 1).when(digits < 10, 2).when(digits < 12, 3).when(digits < 14, 4).when(digits < 16, 5).otherwise(6)
    if kind == "email":
        marks, shape = F.least(F.lit(3), F.length(F.regexp_replace(text, r"[^.]", ""))), F.lit(0)
        valid = text.rlike(r"[A-Za-z]{2,12}$")
    else:
        kinds_of = [F.contains(text, F.lit(c)).cast("int") for c in " .-"]
        marks = kinds_of[0] + kinds_of[1] + kinds_of[2]
        shape = F.when(F.contains(text, F.lit("(")), 2).when(marks > 0, 1).otherwise(0)
        valid = {"ip": within_255(F.regexp_replace(text, r"\x20", "")), "card": luhn(text), "phone": text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")}[kind]
    return [F.lit(KINDS.index(kind)), numbers, marks, shape, char_class(F.right(left, F.lit(1))), char_class(F.left(right, F.lit(1))), left.rlike(CONTEXT[kind]).cast("int"), valid.cast("int")]


def by_rule(kind: str, text: Column) -> Column:
    """Whether a candidate, as a text of its own, is what the kind's rule finds."""
    return text.rlike(f"^(?:{RULES[kind]})$") & confirmed(kind, text)


def candidates(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``cands_<kind>`` for each kind: its proposed spans, with the features of each and whether the rule confirms it."""
    df = with_spans(df, text, {f"cands_{k}": GENERATORS[k] for k in KINDS}, {f"cands_{k}": GENERATORS_NEED[k] for k in KINDS})

    def described(k: str):
        def describe(s: Column) -> Column:
            left = F.substring(F.col(text), F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE)))
            right = F.substring(F.col(text), s["end"] + 1, F.lit(1))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*features(k, s["text"], left, right)).alias("x"), by_rule(k, s["text"]).alias("sure"))

        return describe

    return df.withColumns({f"cands_{k}": F.transform(f"cands_{k}", described(k)) for k in KINDS})


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, most, low, high) down to numbers; the score is the logistic of their sum. ``thresholds`` by kind, None where nothing is added."""

    trees: tuple
    thresholds: dict[str, float | None]

    def margin(self, x: list[int]) -> float:
        return sum(leaf(t, x) for t in self.trees)

    def score(self, x: Column) -> Column:
        total = F.lit(0.0)
        for t in self.trees:
            total = total + as_column(t, x)
        return 1 / (1 + F.exp(-total))


def leaf(tree, x: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def as_column(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], as_column(tree[2], x)).otherwise(as_column(tree[3], x))


def grow(rows: list[tuple], depth: int):
    """A tree by second-order gains; a row is (x, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None)
    if depth:
        for f, n_values in enumerate(FEATURES.values()):
            sums = [[0.0, 0.0] for _ in range(n_values)]
            for x, a, b in rows:
                sums[x[f]][0] += a
                sums[x[f]][1] += b
            gl = hl = 0.0
            for v in range(n_values - 1):
                gl, hl = gl + sums[v][0], hl + sums[v][1]
                if hl <= 0 or h - hl <= 0:
                    continue
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                best = max(best, (gain, (f, v)), key=lambda b: b[0])
    if best[1] is None:
        return RATE * g / (h + 1)
    f, v = best[1]
    return (f, v, grow([r for r in rows if r[0][f] <= v], depth - 1), grow([r for r in rows if r[0][f] > v], depth - 1))


def boosted(cells: list[tuple]) -> tuple:
    """Trees from cells (x, confirmed, others)."""
    trees, margins = [], [0.0] * len(cells)
    for _ in range(TREES if cells else 0):
        rows = []
        for (x, yes, no), m in zip(cells, margins, strict=True):
            p = 1 / (1 + math.exp(-m))
            rows.append((x, yes - (yes + no) * p, (yes + no) * p * (1 - p)))
        trees.append(grow(rows, DEPTH))
        margins = [max(-30.0, min(30.0, m + leaf(trees[-1], x))) for (x, _, _), m in zip(cells, margins, strict=True)]
    return tuple(trees)


def thresholds(trees: tuple, cells: list[tuple]) -> dict[str, float | None]:
    """By kind, the least score over a half from which on at least ``PRECISION`` of the cells' candidates are confirmed, of ``SUPPORT`` or more."""
    out: dict[str, float | None] = {}
    for i, kind in enumerate(KINDS):
        ranked = sorted(((1 / (1 + math.exp(-sum(leaf(t, x) for t in trees))), yes, no) for x, yes, no in cells if x[0] == i), reverse=True)
        yes = no = 0
        out[kind] = None
        for place, (score, a, b) in enumerate(ranked):
            yes, no = yes + a, no + b
            ends = place + 1 == len(ranked) or ranked[place + 1][0] < score
            if ends and score >= 0.5 and yes >= SUPPORT and yes >= PRECISION * (yes + no):
                out[kind] = score
    return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model from all candidates of all texts. A hash of the text deals texts into a fold for thresholds and others for trees, so equal texts share a fold."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = candidates(texts, "t").select((F.pmod(F.xxhash64("t"), F.lit(CALIBRATION_FOLDS)) == 0).alias("held"), F.explode(F.concat(*[f"cands_{k}" for k in KINDS])).alias("c"))
    counted = found.groupBy("held", "c.x").agg(F.count_if("c.sure").alias("yes"), F.count_if(~F.col("c.sure")).alias("no"))
    cells = sorted((r["held"], tuple(r["x"]), r["yes"], r["no"]) for r in counted.collect())  # at most 2 * CELLS rows
    trees = boosted([c[1:] for c in cells if not c[0]])
    return Model(trees, thresholds(trees, [c[1:] for c in cells if c[0]]))


def find(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``pii_<kind>``, the rule's spans, and ``more_<kind>``, what the trees add: arrays of (start, end)."""
    df = wrapped(docs, _t=F.coalesce(F.col(text_col), F.lit("")))
    df = candidates(with_base(df, "_t"), "_t")
    place = "array<struct<start:int,end:int>>"

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(place)

    def chosen(limit: float):
        return lambda s: model.score(s["x"]) >= limit

    def as_numbers(spans: Column) -> Column:
        # array_except compares numbers by hash, structs one by one
        return F.transform(spans, lambda s: F.shiftleft(s["start"].cast("long"), 32) + s["end"])

    def as_places(numbers: Column) -> Column:
        return F.transform(numbers, lambda n: F.struct(F.shiftright(n, 32).cast("int").alias("start"), n.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end"))).cast(place)

    out = []
    for k in KINDS:
        limit = model.thresholds.get(k)
        more = F.array().cast(place) if limit is None else as_places(F.array_except(as_numbers(F.filter(f"cands_{k}", chosen(limit - 1e-9))), as_numbers(F.col(k))))
        out += [bare(F.col(k)).alias(f"pii_{k}"), more.alias(f"more_{k}")]
    return df.select("doc.*", *out)


def joined(spans: dict[str, Column]) -> Column:
    """kind:start:end of all spans, kinds in their order, then by start and end."""

    def written_as(k: str):
        return lambda p: F.concat_ws(":", F.lit(k), p["start"].cast("string"), p["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(F.array_sort(s), written_as(k)) for k, s in spans.items()]), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each of find(): counts and digest of the rules' spans, and all spans."""
    base = {k: F.col(f"pii_{k}") for k in KINDS}
    every = {k: F.concat(f"pii_{k}", f"more_{k}") for k in KINDS}
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


def redact(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each found span of the text replaced by its kind in brackets, where spans overlap by that of the first; a null text becomes an empty one."""
    found = find(docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))), model, text_col="_text")

    def marks(k: str):
        return lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), F.lit(k).alias("kind"))

    marked = F.array_sort(F.concat(*[F.transform(F.concat(f"pii_{k}", f"more_{k}"), marks(k)) for k in KINDS]))
    step = F.aggregate(
        marked,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, m: F.when(m["start"] < a["at"], F.struct(F.greatest(a["at"], -m["back"]).alias("at"), a["done"].alias("done"))).otherwise(
            F.struct((-m["back"]).alias("at"), F.concat(a["done"], F.substring(F.col("_text"), a["at"] + 1, m["start"] - a["at"]), F.lit("["), m["kind"], F.lit("]")).alias("done"))
        ),
    )
    whole = found.withColumn("_step", step).withColumn(text_col, F.concat("_step.done", F.substring(F.col("_text"), F.col("_step.at") + 1, F.length("_text"))))
    return whole.select(*docs.columns)
