"""Personal data: candidate spans, gradient boosting, calibrated thresholds.

Fixed formats give the base spans (email, ip, card, phone), each leftmost and non-overlapping.
High-recall generators then propose more, also overlapping, spans per kind. Boosted trees score
each candidate by its format and context. They are trained on all documents, where
a candidate is positive if it covers a base span of its kind. The generators' own forms (mail with
``[at]``, IPv6, national phone numbers, grouped cards) can't cover one, so all base spans are
also rewritten into these forms, in their context, as positives, and card numbers into order and part
numbers, as negatives; such a form found in the documents themselves is taught as neither, unless it is
part of a base span of another kind. One threshold per kind is calibrated on the candidates of all
documents, each scored by trees that were fitted to the other half of them; a kind without positives
takes the threshold of all kinds together. Texts that repeat count once.

All of it is built-in column expressions: a text is searched, its candidates described and scored
within its own row, without a shuffle. The trees, trained by Spark, become nested conditions.

Spans count code points, end exclusive, and are ordered by kind as listed, then start. Null and
empty texts have none. Repeated rows get equal spans. Without positive and negative candidates in
the documents, only base spans are found. Output names that are taken are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.quality import let
from panelcast.session import stage

KINDS = ("email", "ip", "card", "phone")

#: Trees, depth, the precision asked for, and the parts that calibrate each other's trees.
TREES, DEPTH = 12, 3
PRECISION = 0.95
FOLDS = 2

_LOCAL = "A-Za-z0-9._%+-"
# The four formats. A run that cannot start a match at its first character cannot
# start one later, so matches are only tried at the start of a run or after the last match.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates.
WIDE = {
    "email": (
        rf"(?:(?<![\p{{L}}{_LOCAL}])|\G)[\p{{L}}{_LOCAL}]++@[\p{{L}}0-9-]++(?:\.[\p{{L}}0-9-]++)++"
        rf"|(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?|(?<![0-9+]))(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
_CONTEXT = r"(?i)mail|phone|tel|call|fax|mobile|card|visa|credit|ip\b|address|host|server|contact"


def luhn(digits: Column) -> Column:
    """True if the check sum of a digit string holds."""
    marks = F.split(F.reverse(digits), "", 0)
    marks = F.filter(marks, lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(marks, value), F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column) -> Column:
    n = F.length(_digits(value))
    return n.between(13, 19) & luhn(_digits(value))


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": _card,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def spans(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start,end,value>>``: gaps and matches alternate, so a match
    starts where everything before it ends."""

    def place(matches: Column) -> Column:
        def by_gaps(gaps: Column) -> Column:
            lengths = F.zip_with(
                F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))
            )
            begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

            def step(state: Column, x: Column) -> Column:
                start = state["at"] + x["g"]
                return F.struct((start + x["m"]).alias("at"), F.array_append(state["starts"], start).alias("starts"))

            starts = F.aggregate(lengths, begun, step, lambda s: s["starts"])
            return F.zip_with(
                starts, matches, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value"))
            )

        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), by_gaps)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """The base spans of all kinds: ``array<struct<kind,start,end>>``, ordered."""
    return F.concat(*[_kept(text, kind) for kind in KINDS])


def _kept(text: Column, kind: str) -> Column:
    valid = VALID[kind]
    kept = F.filter(spans(text, BASE[kind]), lambda s: valid(s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def _describe(kind: str, value: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    left, right = F.substring(before, -1, 1), F.substring(after, 1, 1)
    numbers = [
        F.lit(KINDS.index(kind)),
        F.length(value),
        _count(value, "[0-9]"),
        _count(value, r"\p{L}"),
        _count(value, r"[\x20.()-]"),
        _count(value, "[0-9]+"),
        value.startswith("+"),
        value.contains("("),
        value.contains("@"),
        VALID[kind](value),
        left.rlike(r"[\p{L}0-9]"),
        right.rlike(r"[\p{L}0-9]"),
        left.rlike(r"[\x20\n]") | (F.length(before) == 0),
        right.rlike(r"[\x20\n]") | (F.length(after) == 0),
        before.rlike(_CONTEXT),
        F.size(F.array_distinct(F.split(_digits(value), ""))),
    ]
    return [n.cast("double") for n in numbers]


N_FEATURES = 16


def candidates(text: Column) -> Column:
    """All generators' spans: ``array<struct<kind,start,end,x>>``, with features ``x``."""
    return F.concat(*[_candidates(text, kind) for kind in KINDS])


def _candidates(text: Column, kind: str) -> Column:
    def described(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - 19, F.lit(1)), F.least(s["start"], F.lit(20)))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        x = F.array(*_describe(kind, s["value"], before, after))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), x.alias("x"))

    return F.transform(spans(text, WIDE[kind]), described)


#: Characters of context that rewritten spans keep on either side; features read no further.
CONTEXT = 20


def _rewritten(kind: str, value: Column) -> dict[int, list[Column]]:
    """Other forms of a base span: positives (1), and look-alikes of kind phone (0)."""
    digits = _digits(value)
    national = F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]?", "")
    forms = {
        "email": {1: [F.regexp_replace(value, "@", " [at] "), F.regexp_replace(F.regexp_replace(value, "@", "(at)"), r"\.(?=[A-Za-z]+$)", "(dot)")]},
        "ip": {1: [F.regexp_replace(F.md5(value), "(.{4})(?=.)", "$1:")]},
        "card": {
            1: [F.regexp_replace(digits, "(.{4})(?=.)", "$1 "), F.regexp_replace(digits, "(.{4})(?=.)", "$1-")],
            0: [
                F.regexp_replace(F.substring(digits, 1, 12), "(.{4})(?=.)", "$1-"),
                F.concat_ws(" ", F.substring(digits, 1, 2), F.substring(digits, 3, 3), F.substring(digits, 6, 3)),
            ],
        },
        "phone": {1: [national, F.translate(national, "()", "")]},
    }
    return forms[kind]


def _snippets(sample: DataFrame) -> DataFrame:
    """``doc, kind, text, from, upto, label, form, at``: rewritten base spans in their context, the number
    of the form and the start of the span."""
    none = F.array().cast("array<struct<kind:string,text:string,from:int,upto:int,label:double,form:int>>")
    made = []
    value = F.substring("text", F.col("b.start") + 1, F.col("b.end") - F.col("b.start"))
    before = F.substring("text", F.greatest(F.col("b.start") - CONTEXT + 1, F.lit(1)), F.least(F.col("b.start"), F.lit(CONTEXT)))
    after = F.substring("text", F.col("b.end") + 1, F.lit(CONTEXT))
    for kind in KINDS:
        for label, forms in _rewritten(kind, value).items():
            for form in forms:
                row = F.struct(
                    F.lit(kind if label else "phone").alias("kind"),
                    F.concat(before, form, after).alias("text"),
                    F.length(before).alias("from"),
                    (F.length(before) + F.length(form)).alias("upto"),
                    F.lit(float(label)).alias("label"),
                    F.lit(len(made)).alias("form"),
                )
                made.append(F.when(F.col("b.kind") == kind, F.array(row)).otherwise(none))
    spans_ = sample.select("doc", "text", F.explode("base").alias("b"))
    return spans_.select("doc", F.col("b.start").alias("at"), F.inline(F.concat(*made)))


def rewritten_candidates(sample: DataFrame) -> DataFrame:
    """``doc, kind, x, label``: the candidates that cover a rewritten span as a whole; also their place."""
    both = _snippets(sample).select("*", candidates(F.col("text")).alias("found"))
    rows = both.select("doc", "kind", "from", "upto", "label", "form", "at", F.explode("found").alias("c"))
    whole = (F.col("c.kind") == F.col("kind")) & (F.col("c.start") <= F.col("from")) & (F.col("c.end") >= F.col("upto"))
    return rows.where(whole).select("doc", "kind", "c.x", "label", "form", "at", "c.start", "c.end")


def sampled(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc, text, base`` of every text that may hold a candidate; equal texts share a ``doc``."""
    texts = docs.select(F.col(text).alias("text")).where((F.length("text") > 0) & F.col("text").rlike("[0-9@]"))
    return texts.select(F.xxhash64("text").alias("doc"), "text", base_spans(F.col("text")).alias("base"))


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc, kind, x, label`` of all candidates that teach, found and rewritten, once per distinct text.

    Repeated texts give equal rows with equal places, so these narrow rows are made distinct, not the texts."""
    sample = sampled(docs, text)
    both = sample.select("doc", "text", "base", F.explode(candidates(F.col("text"))).alias("c"))
    covered = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] >= F.col("c.start")) & (b["end"] <= F.col("c.end")))
    other = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    value = F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    form = {"email": value.contains("@"), "ip": ~value.contains(":"), "card": F.lit(True), "phone": value.startswith("+")}
    base_form = F.lit(True)
    for kind, fits in form.items():
        base_form = F.when(F.col("c.kind") == kind, fits).otherwise(base_form)
    place = [F.lit(-1).alias("form"), F.lit(-1).alias("at"), "c.start", "c.end"]
    found = both.where(covered | other | base_form).select("doc", "c.kind", "c.x", covered.cast("double").alias("label"), *place)
    return found.unionByName(rewritten_candidates(sample)).distinct().select("doc", "kind", "x", "label")


def held_out(doc: Column, fold: int = 0) -> Column:
    """Whether a document calibrates the trees of a fold, which are fitted to the others."""
    return F.pmod(doc, F.lit(FOLDS)) == fold


@dataclass(frozen=True)
class Model:
    """A margin as a function of a candidate's features, and the least margin per kind."""

    margin: Callable[[Column], Column]
    least: dict[str, float]


def _tree(node, x: Column) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), x), _tree(node.rightChild(), x)
    return F.when(x[split.featureIndex()] <= float(split.threshold()), left).otherwise(right)


def _margin(model: GBTClassificationModel) -> Callable[[Column], Column]:
    """The boosted trees' weighted sum as nested conditions."""
    roots = [(float(w), t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def margin(x: Column) -> Column:
        parts = [F.lit(w) * _tree(root, x) for w, root in roots]
        return sum(parts[1:], parts[0])

    return margin


def _threshold(counts: list) -> float | None:
    """The least margin above which all held-out candidates together have the precision asked for."""
    n = good = 0.0
    least = None
    for at, rows in groupby(sorted(counts, key=lambda r: -r["bin"]), key=lambda r: r["bin"]):
        for row in rows:
            n, good = n + row["n"], good + row["good"]
        if good >= PRECISION * n:
            least = at / 20
    return least


def train(docs: DataFrame, text: str = "text") -> Model | None:
    """Fit on the candidates of all documents. Thresholds come from all of them too, each document's
    candidates scored by trees that were not fitted to it."""
    rows = stage(labelled(docs, text), "pii-candidates")
    if rows.select("label").distinct().count() < 2:
        return None
    columns = [f"x{i}" for i in range(N_FEATURES)]
    flat = rows.select("doc", "kind", "x", "label", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)])
    flat = VectorAssembler(inputCols=columns, outputCol="features").transform(flat)
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11)
    counts = []
    for fold in range(FOLDS):
        fitted = flat.where(~held_out(F.col("doc"), fold))
        if fitted.select("label").distinct().count() < 2:
            continue
        margin = _margin(gbt.fit(fitted))
        scored = flat.where(held_out(F.col("doc"), fold)).withColumn("bin", F.floor(margin(F.col("x")) * 20))
        counts += scored.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    margin = _margin(gbt.fit(flat))
    pooled = _threshold(counts)
    least = {}
    for kind in KINDS:
        own = _threshold([r for r in counts if r["kind"] == kind])
        least[kind] = pooled if own is None else own
    least = {kind: bound for kind, bound in least.items() if bound is not None}
    return Model(margin, least)


def find(df: DataFrame, model: Model | None, text: str = "text", out: str = "spans", base: str = "base_spans") -> DataFrame:
    """Add the base spans, and all spans with those that the model accepts."""
    whole = F.col(text)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    maybe = whole.rlike("[0-9@]") | whole.rlike(r"(?i)[\[(]at[\])]")

    def accepted(found: Column) -> Column:
        def above(c: Column) -> Column:
            least = F.lit(1e9)
            for kind, bound in model.least.items():
                least = F.when(c["kind"] == kind, F.lit(bound)).otherwise(least)
            return model.margin(c["x"]) >= least

        return F.transform(F.filter(found, above), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    def ordered(both: Column) -> Column:
        def of(kind: str) -> Column:
            return F.array_sort(F.filter(both, lambda s: s["kind"] == kind))

        return F.concat(*[of(kind) for kind in KINDS])

    added = accepted(candidates(whole)) if model else none
    marked = df.withColumn(base, F.coalesce(F.when(maybe, base_spans(whole)), none))
    every = F.array_distinct(F.concat(F.col(base), F.coalesce(F.when(maybe, added), none)))
    return marked.withColumn(out, let(every, ordered))
