"""Strict spans beside Python's patterns, chosen ones on planted forms."""

import hashlib
import random
import re

import pytest

from coterie.llm.personal_data import KINDS, find_personal_data, spans_of

SHAPE = "doc_id bigint, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def strict(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind in KINDS
        for m in re.finditer(PATTERNS[kind], text or "")
        if valid(kind, m.group())
    ]


def check(row, text):
    expected = strict(text)
    assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), (text, expected, row.spans)
    counts = [sum(s.startswith(kind) for s in expected) for kind in KINDS]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
    assert set(expected) <= set(row.spans.split(",")) | {""}


def number(rng, size=16):
    while True:
        found = "".join(rng.choices("0123456789", k=size))
        if luhn(found):
            return found


def phone(rng):
    return f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}"


def address(rng):
    return ".".join(str(rng.randrange(256)) for _ in range(4))


def name(rng):
    return "".join(rng.choices("abcdefgh", k=6)) + str(rng.randrange(100))


def corpus(rng, n):
    """Texts with personal data as it is, and with numbers that are none."""
    makers = [
        lambda: f"{name(rng)}@mail{rng.randrange(9)}.example.com",
        lambda: address(rng),
        lambda: number(rng),
        lambda: phone(rng),
        lambda: f'token = "{hashlib.sha1(name(rng).encode()).hexdigest()}"',
        lambda: "".join(rng.choices("0123456789", k=rng.randrange(9, 18))),
        lambda: f"{rng.randrange(300, 999)}.{rng.randrange(999)}.1.2",
        lambda: f"in {rng.randrange(1900, 2030)}",
    ]
    return [f"Some words {rng.choice(makers)()} and others\nhere {rng.choice(makers)()}." for _ in range(n)]


def test_strict_spans_of_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("01259 .-+()@a%é\n_𝒳", k=rng.randrange(120))) for _ in range(3000)]
    texts += ["".join(rng.choices("0129 -", k=60)) for _ in range(1000)]
    texts += ["".join(rng.choices("019.", k=40)) for _ in range(1000)]
    texts += ["".join(rng.choices("a@.+", k=40)) for _ in range(1000)]
    frame = spark.createDataFrame(list(enumerate(texts)), SHAPE).repartition(4)
    found = find_personal_data(frame).collect()
    assert len(found) == len(texts)
    for row in found:
        check(row, texts[row.doc_id])


def test_other_forms_are_chosen_and_clean_texts_are_not(spark):
    rng = random.Random(7)
    texts = corpus(rng, 1500)
    begin = len(texts)
    other = []
    for _ in range(40):
        user, ip, card, call = name(rng), address(rng), number(rng), phone(rng)
        other += [
            ("email", f"{user} (at) host (dot) org"),
            ("ip", ip.replace(".", "[.]")),
            ("card", ".".join(card[k : k + 4] for k in range(0, 16, 4))),
            ("phone", "001" + call[2:]),
        ]
    clean = ["nothing here", "born 12.05.1987 in 1990", "pages 100-200, 3.14159 and 1,000,000", "a@b no point"]
    clean += [f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}" x' for k in range(60)]
    texts += [f"Please note {form} today" for _, form in other] + clean
    found = {r.doc_id: r for r in spans_of(spark.createDataFrame(list(enumerate(texts)), SHAPE)).collect()}
    caught = {kind: 0 for kind in KINDS}
    for k, (kind, form) in enumerate(other):
        spans = found[begin + k].spans
        caught[kind] += any((s.kind, s.start, s.end) == (kind, 12, 12 + len(form)) for s in spans)
    assert min(caught.values()) >= 36, caught
    assert not any(found[k].spans for k in range(begin + len(other), len(texts)))


def test_nulls_repeats_long_texts_and_extra_columns(spark):
    card = "4111 1111 1111 1111"
    long = "word " * 200_000 + "me@host.example" + " 12" * 30_000 + "9" * 5_000 + ".1" * 20_000 + "a" * 5_000 + "@x"
    rows = [(1, None), (None, f"x {card}"), (2, ""), (2, ""), (3, f"+1 234 567 8901 {card}"), (4, long)]
    frame = spark.createDataFrame(rows, SHAPE)
    more = frame.selectExpr("*", "1 as row", "2 as spans", "3 as kind", "4 as found", "5 as score", "6 as label")
    found = find_personal_data(more).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((k is None, k or 0) for k, _ in rows)
    texts = dict(rows)
    for row in found:
        check(row, texts[row.doc_id])
    assert find_personal_data(frame.limit(0)).collect() == []


@pytest.mark.parametrize("table", ["documents"])
def test_no_python_in_the_plan(spark, small, table):
    plan = find_personal_data(spark.read.parquet(f"{small}/{table}.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_every_example_is_learned_from_or_held_out(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.sql import functions as F

    from coterie.llm import personal_data

    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append((rows.count(), rows.rdd.getNumPartitions())) or fit(self, rows))
    monkeypatch.setattr(personal_data, "ROUNDS", 2)
    n = 45_000
    span = F.format_string("%04d %04d %04d %04d", *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) for k in range(4)))
    known = spark.range(n).select(
        F.lit("card").alias("kind"), span.alias("span"), F.lit("my card ").alias("before"), F.lit("").alias("after"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    chooser = personal_data.Chooser(known.union(known))
    fold = F.pmod(F.xxhash64(F.regexp_replace("span", "[^A-Za-z0-9]", "")), F.lit(3)) == 0
    assert chooser.model is not None
    assert seen == [(known.where(~fold).count(), seen[0][1])] and seen[0][0] > 20_000 and seen[0][1] > 1
