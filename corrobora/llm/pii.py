"""Personal data by candidate gradient boosting.

Base spans follow fixed patterns and checks. High-recall generators propose further, overlapping spans: looser
spellings of the same four kinds. Boosted trees score a candidate by its format and its context, and a threshold
for each kind, calibrated for precision, selects what is added to the base spans. The trees learn from the candidates of all
texts, where those that lie on a checked base span are the examples of personal data.

DataFrame functions only: positions come from the pieces between matches, trees become CASE expressions, and a
text's spans never leave its row; only the counts of equal examples are shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import written

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, with possessive loops where giving back cannot help, and look-behinds that start a search
# where a run starts: the same matches, in linear time and without recursion on long runs. The card pattern
# takes whole runs of 12 to 19 digits only; shorter and longer runs would be dropped.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser spellings: words for the marks of an address, blanks or commas in a number, other separators, no plus.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?+[\[(]at[\])]\x20?+)[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?+[\[(]dot[\])]\x20?+)[A-Za-z0-9-]++)++",
    "ip": r"(?<![\p{L}\p{N}_])[0-9]{1,3}+(?:\x20?+[.,]\x20?+[0-9]{1,3}+){3}+(?![\p{L}\p{N}_])",
    "card": r"(?<![\p{L}\p{N}_])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,18}+(?![\p{L}\p{N}_])",
    "phone": r"(?<![\p{L}\p{N}_])[0-9]{1,4}+[)]?+(?:[\x20()./-]{0,2}+[0-9]){6,13}+(?![\p{L}\p{N}_])",
}
# Card numbers beside other numbers: digit groups, what may stand between them, and the lengths of a card's groups.
GROUP = r"(?<![\p{L}\p{N}])[0-9]++(?![\p{L}\p{N}])"
GAP = r"^[\x20./_-]{1,2}$"
CARD_GROUPS = r"^(?:1[2-9]|4-4-4(?:-[1-4])?|4-4-4-4-[1-3]|4-6-[45]|6-13)$"
CONTEXT = 24  # characters before a candidate that count as its context
HINTS = r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|card|visa|account|address|host|server)"
FEATURES = [
    *[f"is_{k}" for k in KINDS], "length", "digits", "letters", "dots", "blanks", "groups", "luhn", "octets", "left_word",
    "right_word", "hinted",
]


def _gated(text: Column, kind: str, loose: bool) -> Column:
    """The text, or nothing where a cheap test tells that the pattern cannot match."""
    if kind != "email":
        test = text.rlike("[0-9]")
    else:
        test = text.contains("@")
        if loose:
            test = test | text.contains("[at]") | text.contains("(at)")
    return F.when(test, text).otherwise("")


def _named(**fields: Column) -> Column:
    """A struct whose fields keep their names, literals too."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _matches(text: Column, pattern: str) -> Column:
    """All matches as structs: value, start and end in code points, and the text before and after up to the next match."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        F.array(F.struct(values.alias("values"), F.split(text, pattern, -1).alias("between"))),
        lambda s: F.transform(F.array(F.struct(
            s["values"].alias("values"), s["between"].alias("between"),
            F.transform(s["values"], lambda v, i: F.length(F.get(s["between"], i)) + F.length(v)).alias("lengths"),
        )), _placed)[0],
    )[0]


def _placed(s: Column) -> Column:
    """Prefix sums in two levels, so that a text with very many matches takes no quadratic time."""
    n, step = F.size(s["values"]), 64
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(n / step).cast("int")), lambda b: _sum(F.slice(s["lengths"], b * step + 1, F.lit(step)))
    )
    with_blocks = F.array(F.struct(blocks.alias("sums")))
    starts = F.transform(with_blocks, lambda b: F.transform(b["sums"], lambda _, k: _sum(F.slice(b["sums"], F.lit(1), k))))[0]

    def place(before: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            start = (
                F.get(before, block) + _sum(F.slice(s["lengths"], block * step + 1, i - block * step))
                + F.length(F.get(s["between"], i))
            )
            return F.struct(
                v.alias("value"), start.alias("start"), (start + F.length(v)).alias("end"),
                F.right(F.get(s["between"], i), F.lit(CONTEXT)).alias("left"),
                F.left(F.get(s["between"], i + 1), F.lit(1)).alias("right"),
            )
        return F.transform(s["values"], one)

    return F.transform(F.array(starts), place)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(1, 21):
        d = F.ascii(F.substring(padded, i, 1)) - 48
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return total % 10 == 0


def _octets(value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All checked base spans, by start and then by kind."""
    def of(at: int, kind: str) -> Column:
        checked = F.filter(_matches(_gated(text, kind, False), BASE[kind]), lambda m: _passes(kind, m["value"]))
        return F.transform(checked, lambda m: _named(start=m["start"], kind=F.lit(at), end=m["end"]))

    return F.array_sort(F.concat(*[of(at, kind) for at, kind in enumerate(KINDS)]))


def _features(kind: str, m: Column) -> dict[str, Column]:
    value, digits = m["value"], _digits(m["value"])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    numbers = {
        "length": F.length(value), "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "dots": F.length(F.regexp_replace(value, "[^.]", "")), "blanks": F.length(F.regexp_replace(value, "[^ ]", "")),
        "groups": F.regexp_count(value, F.lit("[0-9]++")),
    }
    flags = {f"is_{k}": F.lit(k == kind) for k in KINDS} | {
        "luhn": F.length(digits).between(12, 19) & _luhn(digits),
        "octets": _octets(F.regexp_replace(F.regexp_replace(value, " ", ""), ",", ".")),
        "left_word": m["left"].rlike(r"[\p{L}\p{N}_]$"), "right_word": m["right"].rlike(r"^[\p{L}\p{N}_]"),
        "hinted": m["left"].rlike(HINTS),
    }
    return {f: flag(flags[f]) if f in flags else numbers[f].cast("double") for f in FEATURES}


def card_windows(text: Column) -> Column:
    """Card numbers at any group border of a longer row of numbers, overlapping, if grouped like cards and checked."""
    def windows(groups: Column) -> Column:
        def at(first: Column, i: Column) -> Column:
            def of(n: int) -> Column:
                parts = [F.get(groups, i + k) for k in range(n)]
                near = F.lit(True)
                for m in parts[1:]:
                    near = near & m["left"].rlike(GAP)
                lengths = F.concat_ws("-", *[F.length(m["value"]).cast("string") for m in parts])
                value = F.concat(first["value"], *[x for m in parts[1:] for x in (m["left"], m["value"])])
                window = F.struct(
                    value.alias("value"), first["start"].alias("start"), parts[-1]["end"].alias("end"),
                    first["left"].alias("left"), parts[-1]["right"].alias("right"),
                )
                return F.when(near & lengths.rlike(CARD_GROUPS), window)

            # All kinds of card begin with a group of four digits at least.
            listed = F.array_compact(F.array(*[of(n) for n in range(1, 6)]))
            return F.when(F.length(first["value"]) >= 4, listed).otherwise(F.array_compact(F.array(F.when(F.lit(False), listed[0]))))

        return F.filter(F.flatten(F.transform(groups, at)), lambda m: _passes("card", m["value"]))

    # Most texts hold no row of 12 digits at all.
    gated = F.when(text.rlike(r"[0-9]{4}(?:[\x20./_-]{0,2}+[0-9]){8}"), text).otherwise("")
    return F.transform(F.array(_matches(gated, GROUP)), windows)[0]


def candidates(text: Column) -> Column:
    """What the loose generators propose, with features: structs of start, kind, end and the features."""
    def of(at: int, kind: str) -> Column:
        found = _matches(_gated(text, kind, True), LOOSE[kind])
        if kind == "card":
            both = F.array(F.struct(found.alias("loose"), card_windows(text).alias("windows")))
            found = F.transform(both, lambda b: F.concat(b["loose"], F.filter(b["windows"], lambda w: ~F.exists(
                b["loose"], lambda m: (m["start"] == w["start"]) & (m["end"] == w["end"])
            ))))[0]
        return F.transform(found, lambda m: _named(
            start=m["start"], kind=F.lit(at), end=m["end"], **_features(kind, m)
        ))

    return F.concat(*[of(at, kind) for at, kind in enumerate(KINDS)])


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


@dataclass
class Boosted:
    """Trees as nested tuples (feature, bound, left, right) or leaf values, their weights, and thresholds by kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    least: list[float | None] = field(default_factory=lambda: [None] * len(KINDS))

    def margin(self, c: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, bound, left, right = node
            return F.when(c[FEATURES[feature]] <= bound, value(left)).otherwise(value(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + value(tree) * weight
        return total


def _tree(described: str):
    """A tree from the model's own description."""
    lines = iter([x.strip() for x in described.splitlines()[1:] if x.strip()])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        next(lines)
        return int(feature), float(bound), left, node()

    return node()


def fit(
    docs: DataFrame, text: str = "text", trees: int = 8, depth: int = 3, precision: float = 0.98, least_examples: int = 20,
) -> Boosted:
    """Trees and thresholds from the candidates of every text.

    Candidates of equal features and label are one example with their number as its weight, so the trees read far fewer
    rows than there are candidates. A threshold is the lowest margin from which on the candidates of a kind are personal
    data in a share of at least ``precision``, and never below even odds. A kind with fewer than ``least_examples``
    examples above it gets none, and adds nothing.
    """
    t = F.col("t")
    texts = docs.select(F.col(text).cast("string").alias("t")).where(t.rlike("[0-9]") | t.contains("@"))
    rows = texts.select(base_spans(t).alias("base"), F.explode(candidates(t)).alias("c"))
    # What a base span of the kind holds, or all but holds, is an example; a plus before a phone number is its mark.
    on_base = F.exists("base", lambda b: (b["kind"] == F.col("c")["kind"]) & _meets(b, F.col("c")))
    # A card number that passes its check beside the base spans may be one that the base missed: no example at all.
    open_ = (F.col("c.kind") == KINDS.index("card")) & (F.col("c.luhn") == 1) & ~on_base
    each = rows.where(~open_).select(F.when(on_base, 1.0).otherwise(0.0).alias("label"), F.col("c.kind").alias("kind"), *[F.col("c")[f].alias(f) for f in FEATURES])
    examples = written(each.groupBy("label", "kind", *FEATURES).agg(F.count("*").cast("double").alias("weight")), "examples")
    seen = {r.label for r in examples.select("label").distinct().collect()}
    if len(seen) < 2:
        return Boosted()
    # One order, so that a second fit finds the same bounds.
    sorted_ = examples.repartitionByRange(4, *FEATURES).sortWithinPartitions(*FEATURES, "label")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sorted_).select("label", "features", "weight")
    model = GBTClassifier(maxDepth=depth, maxIter=trees, seed=5, maxMemoryInMB=64, weightCol="weight").fit(vectors)
    out = Boosted([_tree(x.toDebugString) for x in model.trees], list(model.treeWeights))
    margin = out.margin(F.struct(*FEATURES))
    levels = examples.groupBy("kind", F.round(margin, 4).alias("margin")).agg(
        F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")
    ).collect()
    for kind in range(len(KINDS)):
        good = n = 0
        for r in sorted((r for r in levels if r.kind == kind), key=lambda r: -r.margin):
            good, n = good + r.good, n + r.n
            if good >= precision * n and good >= least_examples:
                out.least[kind] = max(r.margin - 1e-3, 0.0)
    return out


def spans_of(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """``docs`` with array columns ``pii_base`` and ``pii_spans`` of (start, kind, end), in code points, ends exclusive.

    ``pii_spans`` are the base spans and the candidates that the model selects: those over their kind's threshold
    that meet no base span and no better candidate that is selected. Null and empty texts have none; rows are judged one by one.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("pii_base", base_spans(t))
    asked = [k for k, least in enumerate(model.least) if least is not None]
    if not asked:
        return out.withColumn("pii_spans", F.col("pii_base"))
    enough = lambda c, m: F.greatest(*[
        F.when(c["kind"] == k, m >= model.least[k]).otherwise(False) for k in asked
    ], F.lit(False))
    free = F.filter(candidates(t), lambda c: ~F.exists("pii_base", lambda b: _meets(b, c)))
    scored = F.transform(free, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), model.margin(c).alias("margin")
    ))
    out = out.withColumn("pii_scored", F.filter(scored, lambda c: enough(c, c["margin"])))
    ranked = F.array_sort(F.transform("pii_scored", lambda c: F.struct(
        (-c["margin"]).alias("loss"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")
    )))
    best = F.aggregate(
        ranked, F.filter(ranked, lambda c: F.lit(False)),
        lambda taken, c: F.when(F.exists(taken, lambda o: _meets(o, c)), taken).otherwise(F.array_append(taken, c)),
    )
    added = F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return out.withColumn("pii_spans", F.array_sort(F.concat("pii_base", added))).drop("pii_scored")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(docs: DataFrame, model: Boosted, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; its columns stay as they are.

    Spans that overlap are replaced by the first of them. A null text stays null. Where a text changes, column
    ``length``, if there is one, becomes its new length.
    """
    held = docs.select(F.struct(*docs.columns).alias("kept_row"), F.col(text).cast("string").alias("t"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = _named(at=F.lit(0), parts=F.array().cast("array<string>"))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        part = F.concat(F.substr(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return _named(
            at=F.greatest(acc["at"], s["end"]),
            parts=F.when(skip, acc["parts"]).otherwise(F.array_append(acc["parts"], part)),
        )

    done = F.aggregate("pii_spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(F.col("t"), acc["at"] + 1, F.length("t"))))
    changed = F.size("pii_spans") > 0
    out = spans_of(held, model, "t").withColumn("new", F.when(changed, done).otherwise(F.col("t")))
    kept = {c: F.col("kept_row")[c] for c in docs.columns} | {text: F.col("new")}
    if length in docs.columns:
        kept[length] = F.when(changed, F.length("new").cast(docs.schema[length].dataType)).otherwise(kept[length])
    return out.select(*[c.alias(name) for name, c in kept.items()])
