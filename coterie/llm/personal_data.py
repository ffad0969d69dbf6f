"""Personal data: generators propose spans, boosted trees choose among them.

Strict rules find e-mail addresses, IP addresses, card numbers and phone numbers; what they
find stays. Loose generators propose more, and overlapping, spans: addresses with the at
sign or the points written out, numbers with other separators or without a country's sign.
Gradient-boosted trees, over the format of a span and the words around it, tell them from
numbers that are none. They learn from what the strict rules accept, from rewritten and from
broken forms of it, and from proposals that no rule could accept. For each kind, the
lowest score that keeps its precision on held-out rows is the threshold. Every example of
the table is learned from or held out, by as many tasks as there are rows for.

Only DataFrame functions and the library's own trees are used. The texts are read once.
Patterns use possessive repeats, which need no stack however long a match is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.tables import stage

KINDS = ("email", "ip", "card", "phone")
BEFORE, AFTER = 24, 12  # characters of context that are kept
PARTITION_ROWS = 20_000  # examples in a partition
ROUNDS, DEPTH = 20, 4
PRECISION = 0.95  # of a kind's threshold on held-out rows

STRICT = {
    # a run of name characters is tried once, from its beginning or from the last match on
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs fail in any case
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"[(\[{] ?(?i:at) ?[)\]}]", r"[(\[{] ?(?i:dot|punkt|point|punto) ?[)\]}]"
DATE = r"(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|{AT}) ?[A-Za-z0-9-]++(?: ?(?:\.|{DOT}) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?: ?[(\[]?\.[)\]]? ?[0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./-]{0,2}[0-9]){11,23}+(?![0-9A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z.+])(?!{DATE})(?:\+|\()?[0-9](?:[ ()./-]{{0,2}}[0-9]){{7,15}}+(?![0-9A-Za-z])",
}
#: What a text holds if it holds a span of the kind at all; far cheaper to look for.
HINTS = {
    "email": lambda text: text.contains("@") | text.rlike(AT),
    "ip": lambda text: text.rlike(r"[0-9] ?[(\[]?\."),
    "card": lambda text: text.rlike("[0-9]"),
    "phone": lambda text: text.rlike("[0-9]"),
}
CUES = {
    "email": "mail|contact|write to|schreib|écri|correo",
    "ip": r"\bip\b|host|server|addr|ping|\bfrom\b",
    "card": "card|visa|master|karte|carte|tarjeta|credit|payment",
    "phone": "tel|phone|call|fax|mobil|whatsapp|ruf|appel|llam",
    "other": r"token|key|hash|\bid\b|isbn|version|\bv$|page|fig|\bno\.|order|invoice",
}
SPAN = "array<struct<kind:string,strict:boolean,k:int,gap:int,span:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def proposals(text: Column, kind: str, strict: bool) -> Column:
    """All matches of a text, with the characters between them."""
    pattern = (STRICT if strict else LOOSE)[kind]

    def pieces(gaps: Column) -> Column:
        tails = F.transform(gaps, lambda gap: F.left(gap, F.lit(AFTER)))
        heads = F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            gaps,
            lambda span, gap: F.struct(
                F.length(gap).alias("gap"), span.alias("span"), F.right(gap, F.lit(BEFORE)).alias("before")
            ),
        )
        both = F.zip_with(
            heads, F.slice(tails, 2, F.size(tails)), lambda head, after: F.struct(head.alias("h"), after.alias("after"))
        )
        found = F.filter(both, lambda x: x["h"]["span"].isNotNull())
        return F.transform(
            found,
            lambda x, k: F.struct(
                F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), k.alias("k"), x["h"]["gap"].alias("gap"),
                x["h"]["span"].alias("span"), x["h"]["before"].alias("before"), x["after"].alias("after"),
            ),
        )

    some = HINTS[kind](text) & text.rlike(pattern)
    return F.when(some, let(F.split(text, pattern, -1), pieces)).otherwise(F.array()).cast(SPAN)


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass; false for others."""
    size = F.length(number)

    def part(place: Column) -> Column:
        digit = F.substr(number, size - place + 1, F.lit(1)).cast("int")
        return F.when(place % 2 == 0, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    total = F.aggregate(F.transform(places, part), F.lit(0), lambda a, b: a + b)
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(False)


def largest_part(span: Column) -> Column:
    """The largest of the numbers in a span, 1000 if it has more than three digits."""
    parts = F.filter(F.split(span, "[^0-9]+"), lambda part: part != "")
    plain = F.transform(parts, lambda part: F.regexp_replace(part, "^0+", ""))
    sizes = F.transform(
        plain, lambda part: F.when(F.length(part) > 3, 1000).when(part == "", 0).otherwise(part.try_cast("int"))
    )
    return F.coalesce(F.array_max(sizes), F.lit(0))


def written(span: Column) -> Column:
    """An address with at sign and points."""
    signs = F.regexp_replace(F.regexp_replace(span, AT, "@"), DOT, ".")
    return F.regexp_replace(signs, " ", "")


def holds(kind: Column, span: Column) -> Column:
    """The strict rule's check, whatever signs are between the parts."""
    number = digits(span)
    return (
        F.when(kind == "email", written(span).rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"))
        .when(kind == "ip", largest_part(span) <= 255)
        .when(kind == "card", luhn(number))
        .otherwise(F.length(number).between(9, 15))
    )


def located(found: DataFrame) -> DataFrame:
    """(row, kind, strict, start, end, span, before, after, holds) of every proposal."""
    rows = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    upto = Window.partitionBy("row", "kind", "strict").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("span")).over(upto)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("span"))
    return rows.withColumn("holds", holds(F.col("kind"), F.col("span"))).drop("k", "gap")


def touching(rows: DataFrame) -> DataFrame:
    """Loose proposals with ``touched``, the kind of a strict span they overlap."""
    sure = F.col("strict")
    talk, upto = Window.partitionBy("row"), (Window.unboundedPreceding, 0)
    last = F.max(F.when(sure, F.struct("end", "kind"))).over(talk.orderBy("start").rangeBetween(*upto))
    # backwards, as a frame that begins at the current row is read again for each row
    following = F.min(F.when(sure, F.struct("start", "kind"))).over(talk.orderBy(F.desc("start")).rangeBetween(*upto))
    marked = rows.where("holds or not strict").withColumns({"last": last, "following": following}).where(~sure)
    kind = F.when(F.col("last.end") > F.col("start"), F.col("last.kind")).when(
        F.col("following.start") < F.col("end"), F.col("following.kind")
    )
    return marked.withColumn("touched", kind).drop("last", "following", "strict")


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numbers about the format of ``span`` and about what stands around it."""
    span, before, after = F.col("span"), F.lower("before"), F.col("after")

    def count(pattern: str) -> Column:
        return F.length(span) - F.length(F.regexp_replace(span, pattern, ""))

    found = {f"is_{kind}": F.col("kind") == kind for kind in KINDS}
    found |= {
        "holds": holds(F.col("kind"), span),
        "length": F.length(span),
        "digits": F.length(digits(span)),
        "groups": F.size(F.split(span, "[^0-9]+")),
        "largest": largest_part(span),
        "blanks": count(" "),
        "points": count(r"[.]"),
        "dashes": count("-"),
        "slashes": count("/"),
        "brackets": count(r"[()\[\]{}]"),
        "letters": count("[A-Za-z]"),
        "signs": count("@"),
        "plus": span.startswith("+"),
        "zeros": span.startswith("00"),
        "distinct": F.size(F.array_distinct(F.split(digits(span), ""))),
        "date": span.rlike(DATE),
        "glued_before": F.col("before").rlike(r"[A-Za-z0-9_=#$€£\"'/:.-]$"),
        "glued_after": after.rlike(r"^(?:[A-Za-z0-9_%$€£\"'/:-]|\.[0-9])"),
        "line_begins": F.col("before").rlike(r"(?:^|\n)[ \t|*-]*$"),
    }
    found |= {f"cue_{name}": before.rlike(cue) for name, cue in CUES.items()}
    values = {f"x_{name}": F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in found.items()}
    return rows.withColumns(values), list(values)


def examples(rows: DataFrame, loose: DataFrame) -> DataFrame:
    """(kind, span, before, after, label): what the strict rules say, and forms of it."""
    kind, span, number = F.col("kind"), F.col("span"), digits(F.col("span"))
    split_4 = F.regexp_replace(number, "([0-9]{4})(?=[0-9])", "$1{}")
    good = (
        F.when(kind == "email", F.array(span, F.replace(F.replace(span, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), F.replace(span, F.lit("@"), F.lit(" [at] "))))
        .when(kind == "ip", F.array(span, F.replace(span, F.lit("."), F.lit("[.]")), F.replace(span, F.lit("."), F.lit(" . "))))
        .when(kind == "card", F.array(span, F.replace(split_4, F.lit("{}"), F.lit(".")), F.replace(split_4, F.lit("{}"), F.lit("  "))))
        .otherwise(F.array(span, F.regexp_replace(span, r"^\+", "00"), F.regexp_replace(span, r"^\+[0-9]+ +", "")))
    )
    bad = (
        F.when(kind == "email", F.array(F.regexp_replace(span, r"\..*$", "")))
        .when(kind == "ip", F.array(F.regexp_replace(span, r"\.([0-9]+)$", ".9$1"), F.regexp_replace(span, r"^", "8")))
        .when(kind == "card", F.array(F.translate(span, "0123456789", "1234567890"), F.translate(span, "3456789", "4567893")))
        .otherwise(F.array(number, F.substring(span, 1, 9)))
    )
    forms = F.concat(
        F.transform(good, lambda form: F.struct(form.alias("span"), F.lit(1).alias("label"))),
        F.transform(bad, lambda form: F.struct(form.alias("span"), F.lit(0).alias("label"))),
    )
    sure = rows.where("strict and holds").withColumn("form", F.explode(forms)).drop("span")
    sure = sure.select("kind", "form.span", "before", "after", "form.label")
    # a broken form that holds by chance, and a whole one that does not, is no example
    checked = holds(F.col("kind"), F.col("span"))
    bare = (F.col("kind") == "phone") & F.col("span").rlike("^[0-9]+$")
    sure = sure.where((F.col("label") == checked.cast("int")) | bare)
    cue = F.lower("before").rlike(CUES["phone"])
    wrong = (F.col("touched") != F.col("kind")) | F.col("touched").isNull() & (~F.col("holds") | bare & ~cue)
    return sure.union(loose.where(wrong).select("kind", "span", "before", "after", F.lit(0).alias("label")))


class Chooser:
    """Trees and the thresholds of the kinds; nothing is chosen without examples of both labels."""

    def __init__(self, known: DataFrame):
        self.model, self.thresholds = None, {}
        # every example; dealt and ordered by its values, so that a row is always in the same place
        known = stage(known.distinct(), "known")
        partitions = max(1, math.ceil(known.count() / PARTITION_ROWS))
        values = ["kind", "span", "before", "after", "label"]
        rows, self.names = features(known.repartition(partitions, *values).sortWithinPartitions(*values))
        fold = F.pmod(F.xxhash64(F.regexp_replace("span", "[^A-Za-z0-9]", "")), F.lit(3)) == 0
        rows = stage(self.assembled(rows.withColumn("held_out", fold).withColumn("label", F.col("label").cast("double"))), "examples")
        learned = rows.where("not held_out")
        if learned.select("label").distinct().count() < 2:
            return
        trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=1, featuresCol="features", labelCol="label")
        self.model = trees.fit(learned.select("features", "label"))
        upto = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        # the trees give few different scores, however many rows there are
        held = self.scored(rows.where("held_out")).groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
        kept = held.withColumn("right", F.sum("good").over(upto) / F.sum("n").over(upto))
        kept = kept.where(F.col("right") >= PRECISION).groupBy("kind").agg(F.min("score").alias("score"))
        self.thresholds = {row.kind: max(row.score, 0.5) for row in kept.collect()}  # one for each kind

    def assembled(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol="features").transform(rows).drop(*self.names)

    def scored(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumn("score", F.element_at(vector_to_array("probability"), 2))

    def choose(self, loose: DataFrame) -> DataFrame:
        """(row, kind, start, end): the best of each group of overlapping spans that pass."""
        if self.model is None or not self.thresholds:
            return loose.limit(0).select("row", "kind", "start", "end")
        least = F.create_map(*[F.lit(x) for pair in self.thresholds.items() for x in pair])
        rows = self.scored(self.assembled(features(loose.where("touched is null"))[0]))
        passed = rows.where(F.col("score") >= least[F.col("kind")])
        talk = Window.partitionBy("row").orderBy("start", "end", "kind")
        reached = F.max("end").over(talk.rowsBetween(Window.unboundedPreceding, -1))
        passed = passed.withColumn("new", (F.coalesce(reached, F.lit(-1)) <= F.col("start")).cast("int"))
        passed = passed.withColumn("group", F.sum("new").over(talk.rowsBetween(Window.unboundedPreceding, 0)))
        best = F.max_by(F.struct("kind", "start", "end"), F.struct("score", -F.col("start"), "end", "kind"))
        return passed.groupBy("row", "group").agg(best.alias("best")).select("row", "best.*")


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row: kind, start, end (code points) and whether it is strict.

    ``spans`` is ordered by kind as in ``KINDS`` and by start. Strict spans of one kind do not
    overlap, those of two kinds may; chosen ones overlap no other. A null text is empty and
    has none. Rows come out one for one, repeated ones and those without an id too. Other
    columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(proposals(text, kind, strict) for kind in KINDS for strict in (True, False)))
    found = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")), "proposals")
    rows = stage(located(found), "spans")
    loose = stage(touching(rows), "loose-spans")
    extra = Chooser(examples(rows, loose)).choose(loose)
    sure = rows.where("strict and holds").select("row", "kind", "start", "end", F.lit(True).alias("strict"))
    both = sure.unionByName(extra.withColumn("strict", F.lit(False)))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order")
    lists = both.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(order, "start", "end", "strict", "kind"))).alias("spans")  # of one text
    )
    kind = "array<struct<kind:string,start:bigint,end:bigint,strict:boolean>>"
    spans = F.transform("spans", lambda x: F.struct(x["kind"], x["start"], x["end"], x["strict"])).cast(kind)
    return found.select("row", "doc_id").join(lists, "row", "left").select(
        "doc_id", F.coalesce(spans, F.array().cast(kind)).alias("spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    Counts and hash are of the strict spans alone, ``spans`` lists all; see ``spans_of``.
    """
    sure = F.filter("spans", lambda x: x["strict"])

    def count(kind: str) -> Column:
        return F.size(F.filter(sure, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return spans_of(docs).select(
        "doc_id", *counts, F.sha2(listed(sure).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
