"""Secret spans in texts with built-in functions only (operator 3).

Three patterns give the base spans. Two character Markov models of first order,
one of random strings and one of ordinary identifiers, score every long run of
key characters: a run whose transitions are likelier under the first model, by a
log-likelihood ratio above a threshold, is a further span. The models are learned
from a labelled table of samples.

Positions come from split() and regexp_extract_all() of the same pattern: the
lengths of the pieces and of the matches between them add up to every start.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns by kind, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
#: Characters of the models, and runs that they score.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
RUN = "[A-Za-z0-9+/=_-]{20,}"
SMOOTH = 0.5
#: One sample of so many is held out from the counts, to set the threshold.
HELD = 4
#: The threshold lets so large a share of the held-out ordinary samples pass at most.
FALSE_ALARMS = 0.001
MASK = "[REDACTED]"

#: Words that ordinary identifiers of the labelled samples are made of.
ORDINARY_WORDS = (
    "account action address amount array author balance batch block buffer button cache callback category change channel client code column command comment "
    "component config connection content context control counter country create current customer data database date default delete description detail device "
    "document element email enable entry error event example export failed field file filter first folder format frame function general group handler header "
    "height history image import index information input instance integer internal invoice issue item label language layer length level library license limit "
    "list listener local location login manager market matrix member memory message method model module month name network node notification number object "
    "offset option order original output owner package page parameter parent parse password path payment person picture player point position prefix price "
    "process product profile project property provider public query queue random reader record reference region register release remote remove report request "
    "resource response result return review role schema score screen search section select sequence server service session setting shared signal simple size "
    "source start state status storage stream string style subject submit support symbol system table target task template text thread ticket time title token "
    "total transaction transfer type update upload user utility validate value variable version video view volume warning widget width window worker wrapper "
    "geschichte gesellschaft entwicklung verwaltung bundesrepublik wissenschaft zusammenarbeit veranstaltung einrichtung freundlichkeit "
    "gouvernement administration developpement information association entreprise etablissement naissance connaissance "
    "universidad administracion desarrollo comunicacion informacion conocimiento establecimiento"
).split()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def constant(values: list, kind: str) -> Column:
    """An array of numbers in the plan, as one literal that the optimizer reads: a literal for each would take a call to the JVM for each."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _running(steps: Column, add: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Running sums, or another fold that starts from 0, of an array of n ints in n^1.5 steps: block totals first, then folds inside each block."""
    fold = lambda w, start: F.aggregate(w, start, add)
    zero = F.lit(0)

    def folds(w: Column, c: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.floor((F.size(w) - 1) / c).cast("int")), lambda b: fold(F.slice(w, b * c + 1, c), zero))
        base = let(blocks, lambda t: F.transform(t, lambda _, b: F.when(b == 0, zero).otherwise(fold(F.slice(t, 1, b), zero))))
        return let(base, lambda t: F.transform(w, lambda _, i: fold(F.slice(w, F.floor(i / c).cast("int") * c + 1, i % c + 1), F.get(t, F.floor(i / c).cast("int")))))

    return F.when(F.size(steps) > 0, let(steps, lambda w: let(F.ceil(F.sqrt(F.size(w))).cast("int"), lambda c: folds(w, c)))).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """(start, kind, end) of every match, in code points; keep(text, matches) gives a boolean for each."""

    def located(found: Column, pieces: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, 1, F.size(found)), F.concat(F.array(F.lit("")), found), lambda p, m: F.when(p.isNotNull(), F.length(p) + F.length(m)))
        starts = _running(F.slice(steps, 1, F.size(found)))
        good = keep(text, found) if keep else F.transform(found, lambda _: F.lit(True))
        rows = F.zip_with(starts, F.zip_with(found, good, lambda m, g: F.struct(F.length(m).alias("n"), g.alias("good"))), lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + x["n"]).alias("end"), x["good"].alias("good")))
        return F.transform(F.filter(rows, lambda r: r["good"]), lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), let(_matches(text, pattern), lambda m: let(F.split(text, pattern, -1), lambda p: located(m, p)))).otherwise(none)


def _long_values(text: Column, _: Column) -> Column:
    return F.transform(_matches(text, ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_VALUE)


class MarkovModels:
    """Log-likelihood ratios of character transitions, random against ordinary, and the threshold of a run's total.

    precision and recall are those of the threshold on the held-out samples;
    null where no sample of a class was held out.
    """

    def __init__(self, ratios: list[float], threshold: float = 0.0, precision: float | None = None, recall: float | None = None):
        self.ratios, self.threshold, self.precision, self.recall = ratios, threshold, precision, recall

    def total(self, run: Column) -> Column:
        """The log-likelihood ratio of a string's transitions; characters outside ALPHABET are passed over."""
        n = len(ALPHABET)
        table = constant(self.ratios, "double")

        def summed(at: Column) -> Column:
            return F.when(F.size(at) > 1, F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(at, i - 1) * n + F.get(at, i)))).otherwise(F.lit(0.0))

        at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        return let(F.filter(at, lambda i: i >= 0), summed)

    def is_random(self, run: Column) -> Column:
        """Whether a run of characters is likelier under the random model, by more than the threshold."""
        return self.total(run) > self.threshold


def labelled_samples(spark: SparkSession, n: int = 4000, start: int = 0) -> DataFrame:
    """(label, text): 2n random strings (1) in base 64, hex, capitals and digits; 2n ordinary ones (0).

    The ordinary ones are identifiers in five ways of writing, and rules, counts
    and paths. Row numbers begin at `start`; a row's texts are made from hashes
    of its number, so the same on every machine.
    """
    rows = spark.range(start, start + n)
    draw = lambda k, of: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(of)).cast("int")
    keys = [F.sha2(F.concat(F.lit(x), F.col("id").cast("string")), 256) for x in "rs"]
    base = [F.regexp_replace(F.base64(F.unhex(k)), "[=]", "") for k in keys]
    form = F.col("id") % 4
    strong = F.when(form == 0, F.substring(keys[0], 1, 40)).when(form == 1, F.translate(F.upper(F.regexp_replace(base[0], "[+/]", "")), "018", "247")).when(form == 2, base[0]).otherwise(F.translate(base[0], "+/", "-_"))
    short = F.substring(F.when(form < 2, keys[1]).otherwise(F.translate(base[1], "+/", "-_")), 1, 20 + F.col("id") % 13)
    words = F.array(*map(F.lit, ORDINARY_WORDS))
    a, b, c = (F.get(words, draw(k, len(ORDINARY_WORDS))) for k in (1, 2, 3))
    form = F.col("id") % 5
    name = F.when(form == 0, F.concat(a, b, c)).when(form == 1, F.concat_ws("_", a, b, c)).when(form == 2, F.concat(a, F.initcap(b), F.initcap(c))).when(form == 3, F.concat_ws("_", F.upper(a), F.upper(b))).otherwise(F.concat_ws("-", a, b, draw(4, 100).cast("string")))
    one, sign = (lambda k, of: F.substring(F.lit(of), draw(k, len(of)) + 1, 1)), "+/=_-"
    other = F.when(form == 0, F.repeat(one(5, ALPHABET), 20 + F.col("id") % 40)).when(form == 1, F.repeat(F.concat(one(5, sign), one(6, sign)), 10 + F.col("id") % 20)).when(form == 2, F.concat_ws("/", a, b, c, draw(7, 2000).cast("string"))).when(form == 3, F.concat_ws("-", F.date_add(F.lit("2000-01-01").cast("date"), draw(8, 9000)).cast("string"), a, b)).otherwise(F.concat(F.initcap(a), F.initcap(b), F.initcap(c)))
    parts = ((1, strong), (1, short), (0, name), (0, other))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), t.alias("text")) for k, t in parts))).alias("s")).select("s.label", "s.text")


def train(samples: DataFrame) -> MarkovModels:
    """Models of labelled strings (label 1: random, 0: ordinary). Nulls and other characters are passed over.

    A hash of the text holds out one of HELD samples. The others give the
    counts: the driver gets one for each label and transition, at most twice the
    square of the alphabet. The threshold is the least, 0 at least, that lets
    FALSE_ALARMS of the held-out ordinary samples pass at most.
    """
    real = samples.where("text IS NOT NULL AND label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "text")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    chars = real.where(~held).select("label", F.split("text", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i)))).alias("pair"))
    n, counts = len(ALPHABET), [[0.0] * len(ALPHABET) ** 2 for _ in range(2)]
    for label, pair, seen in pairs.groupBy("label", "pair").count().collect():
        if len(pair) == 2 and pair[0] in ALPHABET and pair[1] in ALPHABET:
            counts[label][ALPHABET.index(pair[0]) * n + ALPHABET.index(pair[1])] += seen

    def logs(c: list[float]) -> list[float]:
        totals = [sum(c[i * n : i * n + n]) for i in range(n)]
        return [math.log((x + SMOOTH) / (totals[i // n] + SMOOTH * n)) for i, x in enumerate(c)]

    models = MarkovModels([round(a - b, 4) for a, b in zip(logs(counts[1]), logs(counts[0]), strict=True)])
    scored = real.where(held & F.col("text").rlike(f"^{RUN}$")).select("label", models.total(F.col("text")).alias("total"))
    of = F.when(F.col("label") == 0, F.col("total"))
    cut = scored.agg(F.percentile(of, 1 - FALSE_ALARMS).alias("at")).first()["at"]
    models.threshold = round(max(0.0, cut or 0.0), 4)
    hit = {(r["label"], r["over"]): r["count"] for r in scored.groupBy("label", (F.col("total") > models.threshold).alias("over")).count().collect()}
    right, wrong, missed = (hit.get(k, 0) for k in ((1, True), (0, True), (1, False)))
    models.precision = right / (right + wrong) if right + wrong else None
    models.recall = right / (right + missed) if right + missed else None
    return models


def secret_spans(text: Column, models: MarkovModels) -> Column:
    """An array of (start, kind, end) by start and kind; kind is a place in KINDS, positions count code points, ends are exclusive."""
    parts = _spans(text, ASSIGN, 0, _long_values), _spans(text, ACCESS, 1), _spans(text, HEX, 2), _spans(text, RUN, 3, lambda _, m: F.transform(m, models.is_random))
    return F.array_sort(F.concat(*parts))


def find_secrets(docs: DataFrame, models: MarkovModels) -> DataFrame:
    """doc_id and secrets, the secret_spans() of the text, for each row of `docs` (doc_id, text).

    Null and empty texts have no secrets; every row gives a row, equal texts
    equal spans; other columns are not read; an empty table gives an empty one.
    """
    return docs.select("doc_id", secret_spans(F.coalesce(F.col("text"), F.lit("")), models).alias("secrets"))


def merged(spans: Column) -> Column:
    """The unions (start, end) of secret_spans() that overlap or touch."""

    def joined(reach: Column) -> Column:
        flagged = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), ((i == 0) | (s["start"] > F.get(reach, i - 1))).alias("new")))
        last = lambda after: F.coalesce(after["i"], F.size(reach)) - 1
        return let(F.filter(flagged, lambda x: x["new"]), lambda f: F.zip_with(f, F.slice(f, 2, F.size(f)), lambda x, after: F.struct(x["start"].alias("start"), F.get(reach, last(after)).alias("end"))))

    return let(_running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), joined)


def masked(text: Column, spans: Column) -> Column:
    """The text with MASK in place of each of the (start, end), which rise and don't overlap.

    Blocks of spans are cut out of the text first, and spans out of their
    block, since a cut takes as long as what stands before it.
    """

    def block(b: Column, c: Column) -> Column:
        inside = F.slice(spans, b * c + 1, c)
        start = F.when(b == 0, F.lit(0)).otherwise(F.get(spans, b * c - 1)["end"])

        def cut(part: Column, first: Column) -> Column:
            before = lambda i: F.when(i == 0, first).otherwise(F.get(inside, i - 1)["end"])
            return F.array_join(F.transform(inside, lambda s, i: let(before(i), lambda at: F.concat(F.substring(part, at - first + 1, s["start"] - at), F.lit(MASK)))), "")

        return let(start, lambda first: let(F.substring(text, first + 1, F.element_at(inside, -1)["end"] - first), lambda part: cut(part, first)))

    def whole(c: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / c).cast("int"))
        return F.concat(F.array_join(F.transform(blocks, lambda b: block(b, c)), ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.ceil(F.sqrt(F.size(spans))).cast("int"), whole)).otherwise(text)


def redact(text: Column, models: MarkovModels) -> Column:
    """The text with MASK in place of every secret: the unions of all secret_spans() of the original text. Null stays null."""
    return F.when(text.isNotNull(), let(text, lambda t: let(secret_spans(t, models), lambda s: let(merged(s), lambda m: masked(t, m)))))
