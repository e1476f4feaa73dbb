"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

Spans that pass the base checks (form and checksum) always stay. The trees decide over the rest: spans of base form that
fail a check, and spans of other forms. They learn from the corpus itself: a candidate of base form is labelled by
its check, any other by an explicit cue word before it; cue words and checks of its own kind are not inputs there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import let, stored

# The base kinds, in this order, with their forms (possessive: no backtracking over long runs).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
# Further generators; a kind may have a base form as well.
MORE = (("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
        ("phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
        ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        ("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Z0-9])"),
        ("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])"))
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
CUES = r"(?i)(?:mail|phone|tel|call|contact|card|visa|account|address|server|host|token|key|secret|passw|iban|ssn|social)[^\n]{0,12}$"
COUNTER = r"(?i)(?:version|order|isbn|issn|doi|page|chapter|section|no\.|nr\.|#)[^\n]{0,4}$"
SPAN = "array<struct<start: int, end: int, m: string>>"
CHUNK = 256
NESTED = (1024, 32)         # spans are taken in chunks of chunks, so that no step goes over the whole text or all spans for each span
CONTEXT = 24                # characters before a span that its features look at


@dataclass(frozen=True)
class Fit:
    """The trees are fitted on four fifths of all distinct feature rows, weighted by their counts in the whole corpus; the
    other fifth sets the thresholds."""

    trees: int = 12
    depth: int = 3
    precision: float = 0.95
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """Trees as (weight, nested splits), and the least probability per kind; kinds without one add no spans."""

    trees: tuple
    thresholds: dict

    def probability(self, x: Column) -> Column:
        def tree(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            at, threshold, left, right = node
            return F.when(F.get(x, F.lit(at)) <= threshold, tree(left)).otherwise(tree(right))
        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + weight * tree(root)
        return 1 / (1 + F.exp(-2 * margin))


def positions(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, m) in code points, end exclusive.

    The text between matches gives the starts; they are added up in chunks, so a text of m matches costs m * 256 at most.
    """
    def of(s: Column) -> Column:
        lens = F.transform(s["h"], lambda m, i: F.struct(F.length(F.get(s["p"], i)).alias("gap"), F.length(m).alias("n")))
        def walk(all_: Column) -> Column:
            part = lambda k: F.slice(all_, k * CHUNK + 1, CHUNK)
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")),
                               lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
            starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
            inside = lambda first, k: F.aggregate(
                part(k), F.struct(first.alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out")),
                lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(a["out"], F.struct(
                    (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"))).alias("out")), lambda a: a["out"])
            return F.flatten(F.transform(let(starts, lambda st: F.slice(st, 1, F.size(st) - 1)), inside))
        spans = let(lens, walk)
        return F.when(F.size(s["h"]) > 0, let(spans, lambda sp: F.transform(sp, lambda x, i: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.get(s["h"], i).alias("m"))))).otherwise(F.array().cast(SPAN))
    both = F.struct(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    return F.when(gate, let(both, of)).otherwise(F.array().cast(SPAN))


def chunks(spans: Column, size: int) -> Column:
    """The array in slices of ``size``; none of an empty one."""
    many = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(many, lambda k: F.slice(spans, k * size + 1, F.lit(size)))


def per_piece(text: Column, base: Column, spans: Column, body, pad: int, sizes: tuple[int, ...] = NESTED) -> Column:
    """``body(piece, at, some)`` for chunks of spans in order, with the piece of text around them and its place; the arrays joined.

    A piece goes from ``pad`` characters before the chunk's first span to one after its last.
    """
    if not sizes:
        return body(text, base, spans)

    def one(some: Column) -> Column:
        low = F.greatest(F.get(some, F.lit(0))["start"] - pad, base)
        high = F.element_at(some, -1)["end"] + 1
        cut = F.struct(low.alias("low"), F.substring(text, low - base + 1, high - low).alias("piece"))
        return let(cut, lambda c: per_piece(c["piece"], c["low"], some, body, pad, sizes[1:]))
    return F.flatten(F.transform(chunks(spans, sizes[0]), one))


def with_context(text: Column, spans: Column) -> Column:
    """Spans of one pattern, in order, each with what stands ``before`` and ``after`` it."""
    def inside(piece: Column, at: Column, some: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.greatest(s["start"] - CONTEXT, F.lit(0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"),
                            F.substring(piece, first - at + 1, s["start"] - first).alias("before"), F.substring(piece, s["end"] - at + 1, F.lit(1)).alias("after"))
        return F.transform(some, one)
    return per_piece(text, F.lit(0), spans, inside, CONTEXT)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """All proposed spans: ``kind`` (place in KINDS), start, end, m, ``ok`` (base check passed; null without one)."""
    gates = {EMAIL: F.contains(text, F.lit("@")), IP: text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), CARD: text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
             PHONE: F.contains(text, F.lit("+"))}
    out = []
    for kind, pattern, gate, base in [*[(k, p, gates[p], True) for k, p in BASE], *[(k, p, text.rlike(p), False) for k, p in MORE]]:
        found = let(positions(text, pattern, gate), lambda spans: with_context(text, spans))
        out.append(F.transform(found, lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"),
            (passes(kind, s["m"]) if base else F.lit(None).cast("boolean")).alias("ok"), s["before"].alias("before"), s["after"].alias("after"))))
    return F.filter(F.concat(*out), lambda c: F.coalesce(c["ok"], F.lit(True)) | (c["end"] - c["start"] >= 7))


def features(c: Column) -> Column:
    """Format and context of a candidate as numbers."""
    m, size = c["m"], F.length(c["m"])
    count = lambda p: size - F.length(F.regexp_replace(m, p, ""))
    after = c["after"]
    flag = lambda x: x.cast("double")
    return let(c["before"], lambda b: F.array(
        c["kind"].cast("double"), F.least(size, F.lit(64)).cast("double"), count("[0-9]").cast("double"), count("[A-Za-z]").cast("double"),
        count(r"[\x20().-]").cast("double"), F.size(F.array_distinct(F.split(m, ""))).cast("double"), flag(m.startswith("0")),
        F.when(c["ok"].isNotNull(), flag(b.rlike(CUES))).otherwise(0.0), flag(b.rlike(COUNTER)), flag(b.rlike(r"[:=][\x20\"']*$")),
        flag(b.rlike(r"[\"'(]$")), flag(b.rlike(r"[\p{L}0-9]$")), flag(after.rlike(r"[\p{L}0-9]"))))


def label(c: Column) -> Column:
    return F.coalesce(c["ok"], c["before"].rlike(CUES)).cast("double")


def accepted(c: Column) -> Column:
    return F.coalesce(c["ok"], F.lit(False))


def untouched(rest: Column, base: Column, sizes: tuple[int, ...] = NESTED) -> Column:
    """The spans of ``rest`` that touch none of ``base``; a chunk is compared only with those near it."""
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    if not sizes:
        return F.filter(rest, lambda c: ~F.exists(base, lambda b: touch(b, c)))

    def one(some: Column) -> Column:
        whole = F.struct(F.array_min(F.transform(some, lambda c: c["start"])).alias("start"), F.array_max(F.transform(some, lambda c: c["end"])).alias("end"))
        near = let(whole, lambda w: F.filter(base, lambda b: touch(b, w)))
        return let(near, lambda some_base: untouched(some, some_base, sizes[1:]))
    return F.flatten(F.transform(chunks(rest, sizes[0]), one))


def open_to_trees(all_: Column) -> Column:
    """``base``: the accepted base spans; ``free``: the other candidates that touch none of them."""
    both = F.struct(F.filter(all_, accepted).alias("base"), F.filter(all_, lambda c: ~accepted(c)).alias("rest"))
    return let(both, lambda s: F.struct(s["base"].alias("base"), untouched(s["rest"], s["base"]).alias("free")))


def fit(docs: DataFrame, how: Fit = Fit(), text: str = "text") -> Model:
    """Fit on the base spans and the candidates that find() may select, counted by feature row; without both labels the model selects nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    seen = let(candidates(t), lambda all_: let(open_to_trees(all_), lambda s: F.concat(s["base"], s["free"])))
    rows = docs.select(F.explode(F.transform(seen, lambda c: F.struct(features(c).alias("x"), label(c).alias("label")))).alias("r")).select("r.*")
    rows = rows.groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = rows.withColumn("h", F.xxhash64("x", F.lit(how.seed)))
    rows = stored(rows.withColumn("held", F.pmod("h", F.lit(5)) == 0).withColumn("features", array_to_vector("x")), "pii")
    train = rows.filter("not held")
    if train.select("label").distinct().count() < 2:
        return Model((), {})
    made = GBTClassifier(maxIter=how.trees, maxDepth=how.depth, weightCol="weight", seed=how.seed, stepSize=0.3).fit(train)

    def node(n) -> tuple:
        if n.subtreeDepth() == 0:
            return (float(n.prediction()),)
        return int(n.split().featureIndex()), float(n.split().threshold()), node(n.leftChild()), node(n.rightChild())

    model = Model(tuple((float(w), node(t._call_java("rootNode"))) for w, t in zip(made.treeWeights, made.trees)), {})
    scored = rows.filter("held").select(F.get("x", F.lit(0)).cast("int").alias("kind"), model.probability(F.col("x")).alias("p"), "label", "weight")
    return Model(model.trees, thresholds(scored, how.precision))


def thresholds(scored: DataFrame, precision: float) -> dict:
    """Per kind the least probability above one half from which up ``precision`` of the weight is labelled 1.

    Rows ``kind, p, label, weight`` merge by probability first, of which the trees give few.
    """
    each = scored.groupBy("kind", "p").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("y"))
    up = Window.partitionBy("kind").orderBy(F.desc("p"))
    bar = each.select("kind", "p", (F.sum("y").over(up) >= precision * F.sum("n").over(up)).alias("right"))
    return {r.kind: r.p for r in bar.filter("right and p > 0.5").groupBy("kind").agg(F.min("p").alias("p")).collect()}


def find(docs: DataFrame, model: Model, text: str = "text", name: str = "pii") -> DataFrame:
    """The rows with a struct ``pii``: ``base`` and ``spans``, arrays of (start, kind, end), sorted; a map, no shuffle.

    ``kind`` is a place in KINDS. Selected spans that touch a base span are dropped: base spans stay as they are. Null or
    empty text has none. A column of that name is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    slim = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))

    def chosen(all_: Column) -> Column:
        def picked(s: Column) -> Column:
            base, free = F.transform(s["base"], slim), s["free"]
            if not model.trees or not model.thresholds:
                added = F.filter(F.transform(free, slim), lambda c: F.lit(False))
            else:
                least = F.lit(2.0)
                def wanted(c: Column) -> Column:
                    bar = least
                    for kind, p in model.thresholds.items():
                        bar = F.when(c["kind"] == kind, p).otherwise(bar)
                    return let(features(c), model.probability) >= bar
                added = F.transform(F.filter(free, wanted), slim)
            once = let(F.sort_array(F.concat(base, added)), lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~F.get(all_, i - 1).eqNullSafe(x)))
            return F.struct(F.sort_array(base).alias("base"), once.alias("spans"))
        return let(open_to_trees(all_), picked)

    return docs.withColumn(name, let(candidates(t), chosen))


def digest(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans (sorted, as find() gives them) replaced by its first kind, as ``[EMAIL]``."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = F.transform(chunks(spans, CHUNK), lambda some: F.array_max(F.transform(some, lambda s: s["end"])))
    reached = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.array_append(a, F.greatest(F.element_at(a, -1), e)))

    def opening(some: Column, end: Column) -> Column:
        """Spans that begin a run, each with the end of the run before."""
        start = F.struct(end.alias("end"), F.array().cast("array<struct<start: int, kind: int, end: int>>").alias("out"))
        return F.aggregate(some, start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.when(
            s["start"] >= a["end"], F.array_append(a["out"], F.struct(a["end"].alias("start"), s["kind"].alias("kind"), s["start"].alias("end")))).otherwise(a["out"]).alias("out")),
            lambda a: a["out"])

    gaps = let(reached, lambda r: F.flatten(F.transform(chunks(spans, CHUNK), lambda some, k: opening(some, F.get(r, k)))))
    cut = lambda piece, at, some: F.transform(some, lambda g: F.concat(F.substring(piece, g["start"] - at + 1, g["end"] - g["start"]), F.get(names, g["kind"])))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(let(gaps, lambda g: per_piece(text, F.lit(0), g, cut, 0)), ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)
