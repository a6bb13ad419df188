"""Personal data: base patterns, and more spans by boosted trees over wide candidates.

Everything is columns: patterns are split at and extracted, spans are arrays of structs,
and the trees, trained by Spark's gradient boosting, are applied as nested conditions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.llm.quality import let
from logharrow.operators.pin import pin
from logharrow.session import settled

KINDS = ("email", "ip", "card", "phone")
# The patterns asked for, with possessive repeats where nothing behind them could match
# otherwise, and begun only where a run begins or the match before ended; the matches are
# the same. A card is matched as the whole chain of digits, of 16 to 19 digits.
RUN = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{RUN})){RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Wide generators: also numbers without a plus (a country's number behind one is left out, so both look alike), disguised addresses, long digit groups.
AT = r"(?:@|\x20?[(\[{]at[)\]}]\x20?)"
DOT = r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?)"
DOTS = r"(?:\.|\x20?[(\[{](?:\.|dot)[)\]}]\x20?)"  # also 1[.]2(dot)3[.]4
CANDIDATES = {
    "email": rf"(?:\G|(?<!{RUN})){RUN}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{DOTS}[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
HINTS = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|pay|account|credit",
    "phone": "phone|tel|call|fax|mobile|number",
}
# Forms that are none of a kind, whatever stands around them.
VERSION = r"(?i)(?:\bv|\bver\.?|\bversion|\brelease|\bbuild)[:\x20]?$"
DATE = r"^\(?(?:19|20)[0-9]{2}\)?[\x20.-](?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[\x20.-]"
NO_EMAIL = r"^\.|\.\.|\.@|\.[0-9-]+$"
CONTEXT = 40
LEVELS = 1000
# What makes a candidate a base match (sign, dots, number of digits, plus) is no feature: it would
# be all there is to learn, and what is added lacks just that.
FEATURES = (
    "kind", "letters", "spaces", "dashes", "brackets", "groups", "luhn", "octets",
    "letter_before", "digit_before", "letter_after", "hint", "digits_around", "zeros",
)
SPAN = "array<struct<kind:int,start:int,end:int,hit:string>>"


def luhn(digits: Column) -> Column:
    """The check sum of card numbers, over a text of digits; FALSE for an empty one."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, b: a + b)
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.rlike(hit, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        return luhn(only_digits(hit))
    if kind == "phone":
        return F.length(only_digits(hit)).between(8, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda span: valid(kind, span["hit"])


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern as spans in code points, end exclusive."""
    none = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        def walk(between: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                start = state["at"] + F.length(F.get(between, i))
                hit = F.get(hits, i)
                end = start + F.length(hit)
                span = F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("hit")
                )
                return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

            first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), first, step)["spans"]

        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), walk)).otherwise(none)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    need = NEEDS[kind] if pattern == PATTERNS[kind] else ""
    return F.when(F.contains(text, F.lit(need)), found).otherwise(none) if need else found


def base_spans(text: Column) -> Column:
    """The spans of the base patterns that pass their checks, by kind as listed, then start."""
    each = [F.filter(matches(text, k, PATTERNS[k]), passing(k)) for k in KINDS]
    return F.concat(*each)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def plain(kind: str, hit: Column) -> Column:
    """A candidate as it is without its disguise."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(hit, AT, "@"), DOT, ".")
    return F.regexp_replace(hit, DOTS, "." if kind == "ip" else "-")


def before(text: Column, span: Column) -> Column:
    return F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))


def wrong(text: Column, kind: str, span: Column, base: Column) -> Column:
    """Whether a candidate is of a form known to be none of its kind; TRUE makes it a negative example."""
    hit = plain(kind, span["hit"])
    version = F.rlike(before(text, span), F.lit(VERSION))
    if kind == "email":
        return F.rlike(hit, F.lit(NO_EMAIL))
    if kind == "ip":
        return ~valid("ip", hit) | version
    if kind == "card":
        return ~luhn(only_digits(hit))
    other = F.exists(base, lambda b: (b["kind"] != KINDS.index(kind)) & overlaps(b, span))
    return other | version | F.rlike(hit, F.lit(DATE)) | ~valid("phone", hit)


def features(text: Column, kind: str, span: Column) -> Column:
    """Format and context of one candidate, as a struct of doubles; the format is that without disguise."""
    hit, around = plain(kind, span["hit"]), before(text, span)
    around = F.regexp_replace(around, r"\+[0-9]{0,3}[\x20-]?$", "")
    after = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    digits = only_digits(hit)
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "letters": count(hit, r"\p{L}"),
        "spaces": count(hit, r"\x20"),
        "dashes": count(hit, "-"),
        "brackets": count(hit, r"[()\[\]{}]"),
        "groups": count(hit, "[0-9]+"),
        "luhn": luhn(digits),
        "octets": valid("ip", hit),
        "letter_before": F.rlike(around, F.lit(r"\p{L}$")),
        "digit_before": F.rlike(around, F.lit(r"[0-9][.,:/\x20-]?$")),
        "letter_after": F.rlike(after, F.lit(r"^\p{L}")),
        "hint": F.rlike(around, F.lit(rf"(?i)\b(?:{HINTS[kind]})")),
        "digits_around": count(around, "[0-9]") + count(after, "[0-9]"),
        "zeros": count(hit, "0"),
    }
    return F.struct(*[values[name].cast("int").cast("double").alias(name) for name in FEATURES])


def candidates(text: Column, base: Column) -> Column:
    """Overlapping candidates of all generators: span, features and label.

    The label is TRUE if a base span of its kind meets it, FALSE if its form is known to be
    wrong, and NULL for plausible ones, which may be what is looked for.
    """

    def of_kind(kind: str) -> Column:
        same = F.filter(base, lambda b: b["kind"] == KINDS.index(kind))
        return F.transform(
            matches(text, kind, CANDIDATES[kind]),
            lambda s: F.struct(
                s.alias("span"),
                features(text, kind, s).alias("features"),
                F.when(F.exists(same, lambda b: overlaps(b, s)), True).when(wrong(text, kind, s, base), False).alias("label"),
            ),
        )

    return F.concat(*map(of_kind, KINDS))


@dataclass(frozen=True)
class Training:
    """Bounds of the sample the trees are fitted on, and what they must reach.

    A quarter of ``rows`` candidates of each kind, the first by a hash of document and place,
    is fitted. Those that meet a valid base span of their kind are true, forms known to be
    wrong are false. Plausible ones are not known to be either: they only show what is not
    like base spans, with ``weight`` of a known one, and count for no threshold.
    Thresholds come from the scores of all known candidates of the table: a kind's own is the
    lowest from which ``precision`` is reached, but not below what the share ``reach`` of
    its true ones has. It is drawn towards ``rare`` as if by ``least`` more true ones, by the same
    formula however many there are, so it moves little by little as a table grows.
    """

    rows: int = 20_000
    trees: int = 12
    depth: int = 4
    precision: float = 0.99
    least: int = 20
    seed: int = 7
    weight: float = 0.1
    reach: float = 0.95
    rare: float = 0.5


class Trees:
    """Boosted trees as a condition per node, with a threshold for each kind."""

    def __init__(self, model, thresholds: dict[int, int]):
        self.trees = [
            (weight, _nodes(tree._call_java("rootNode"))) for weight, tree in zip(model.treeWeights, model.trees)
        ]
        self.thresholds = thresholds

    def score(self, row: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * _applied(t, row) for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * margin))

    def level(self, score: Column) -> Column:
        """Scores in thousandths, so that counts per score are few; thresholds are such."""
        return F.floor(score * LEVELS).cast("int")


def _nodes(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return (split.featureIndex(), split.threshold(), _nodes(node.leftChild()), _nodes(node.rightChild()))


def _applied(node, row: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(row[FEATURES[feature]] <= threshold, _applied(left, row)).otherwise(_applied(right, row))


def train(found: DataFrame, how: Training) -> Trees | None:
    """Trees from candidates (id, c), or None if the sample has not both labels."""
    key = F.xxhash64("id", "c.span.kind", "c.span.start", F.lit(how.seed))
    every = found.select(F.explode("candidates").alias("c"), "id").select(
        key.alias("key"), F.col("c.label").cast("double").alias("known"), "c.features.*"
    )
    every = settled(every, "pii-candidates")
    each = [
        every.where(F.col("kind") == kind).orderBy("key", *FEATURES).limit(how.rows // len(KINDS))
        for kind in range(len(KINDS))
    ]
    sample = settled(reduce(DataFrame.unionAll, each), "pii-sample")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(sample).select(
        "vector", F.coalesce("known", F.lit(0.0)).alias("label"),
        F.when(F.col("known").isNull(), how.weight).otherwise(1.0).alias("weight"),
    )
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=how.trees, maxDepth=how.depth, seed=how.seed
    ).fit(rows.coalesce(4))
    trees = Trees(model, {})
    # All known candidates of the table, counted by kind and level.
    known = every.where("known IS NOT NULL").withColumn("level", trees.level(trees.score(F.struct(*FEATURES))))
    counts = known.groupBy("kind", "level").agg(F.sum("known").alias("true"), F.count("*").alias("all")).collect()
    for kind in range(len(KINDS)):
        levels = sorted(((r.level, r.true, r["all"]) for r in counts if r.kind == kind), reverse=True)
        trees.thresholds[kind] = precise_level(levels, how)
    return trees


def precise_level(levels: list[tuple[int, float, int]], how: Training) -> int:
    """The threshold of a kind from its levels, highest first, with true and all known ones at each."""
    total = sum(n for _, n, _ in levels)
    true = every = 0.0
    found = reached = LEVELS
    for level, n, known in levels:
        true, every = true + n, every + known
        if true >= how.precision * every:
            found = level
        if reached == LEVELS and true >= how.reach * total:
            reached = level
    return round((total * max(found, reached) + how.least * how.rare * LEVELS) / (total + how.least))


def added_spans(cands: Column, base: Column, trees: Trees) -> Column:
    """Candidates over the threshold of their kind that meet no base span; of overlapping ones the best.

    A candidate of a form known to be wrong is none, as a card number that fails its check sum.
    """

    scored = F.transform(
        F.filter(cands, lambda c: c["label"].isNull() & ~F.exists(base, lambda b: overlaps(b, c["span"]))),
        lambda c: F.struct(
            (-trees.score(c["features"])).alias("minus"), c["span"]["start"].alias("start"), c["span"].alias("span")
        ),
    )

    def over(s: Column) -> Column:
        limit = F.lit(LEVELS + 1)  # no score reaches it
        for kind, threshold in trees.thresholds.items():
            limit = F.when(s["span"]["kind"] == kind, F.lit(threshold)).otherwise(limit)
        return trees.level(-s["minus"]) >= limit

    def take(chosen: Column, s: Column) -> Column:
        return F.when(F.exists(chosen, lambda c: overlaps(c, s["span"])), chosen).otherwise(
            F.concat(chosen, F.array(s["span"]))
        )

    return F.aggregate(F.sort_array(F.filter(scored, over)), F.array().cast(SPAN), take)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are merged."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), F.lit("]"))
        gap = F.substring(text, state["at"] + 1, F.greatest(s["s"] - state["at"], F.lit(0)))
        out = F.when(s["s"] >= state["at"], F.concat(state["out"], gap, mark)).otherwise(state["out"])
        return F.struct(F.greatest(s["e"], state["at"]).alias("at"), out.alias("out"))

    done = F.aggregate(ordered, first, step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Training = Training(),
    with_text: bool = True,
) -> DataFrame:
    """Personal data of every whole text.

    Returns ``id_col``, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base
    and added ones as text), n_added and, with ``with_text``, redacted_text. One row per row
    of ``docs``, nothing is shuffled but the bounded training sample and counts per score; other columns are not
    read. NULL and empty texts have no spans. Tables without candidates of both labels get
    the base spans alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = pin(rows, base=base_spans(F.col("text")))
    found = pin(rows, candidates=candidates(F.col("text"), F.col("base")))
    trees = train(found, training)
    extra = added_spans(F.col("candidates"), F.col("base"), trees) if trees else F.array().cast(SPAN)
    done = pin(found, extra=extra)
    every = F.array_sort(F.concat("base", "extra"))  # by kind, then start
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = [
        F.col("id").alias(id_col),
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size("extra").cast("long").alias("n_added"),
    ]
    return done.select(*out, *[redacted(F.col("text"), every).alias("redacted_text")] * with_text)
