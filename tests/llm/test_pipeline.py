"""Each stage of the pipeline against plain Python, on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from coterie.llm.tables import stage
from test_line_dedup import plain as plain_lines
from test_ngram_join import plain as plain_links
from test_tokens import word_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "packing"]
    results = [docs]
    for name, apply in corpus_pipeline.STAGES:
        results.append(stage(apply(spark, results[-1], small), f"test-{name}"))
    given, clean, lines, single, packed = map(rows_of, results[:4] + [results[3]])
    assert all(frame.columns == COLUMNS for frame in results[:4])

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(given[k] == clean[k] for k in clean)
    assert all(labels.get(k) != 0 for k in set(given) - set(clean))

    expected = {d: text for d, text, _, _ in plain_lines([(k, r.text) for k, r in clean.items()], 40, 5)}
    assert {k: r.text for k, r in lines.items()} == expected
    assert all(r.n_chars == (len(r.text) if r.text != clean[k].text else clean[k].n_chars) for k, r in lines.items())

    linked = plain_links([(k, r.text) for k, r in lines.items()], 5, 80)
    assert set(single) == {doc_id for doc_id, _, root in linked if doc_id == root}
    assert all(single[k] == lines[k] for k in single)

    pieces = results[4]
    ids = dict(zip(single, word_ids([r.text for r in single.values()])))
    found = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert found == {k: len(v) + 1 for k, v in ids.items()}
    fills = [r.n for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(fills) <= 4096 and len(fills) <= -(-sum(fills) // 4096) + 1


def test_nulls_repeats_and_nothing(spark, small):
    rows = [
        (1, "one two three four five six seven", "en", "s", 33),
        (1, "one two three four five six seven", "en", "s", 33),
        (2, "one two three four five six seven", "en", "s", 33),
        (None, "one two three four five six seven", None, None, None),
        (None, "alone in having no id at all", None, None, None),
        (3, None, None, "s", None),
        (4, "", "en", None, 0),
    ]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    for _, apply in corpus_pipeline.STAGES[:3]:
        docs = stage(apply(spark, docs, small), "test-edge")
    kept = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    # rows without an id stay
    assert kept == [(0, rows[4][1]), (0, rows[0][1]), (1, rows[0][1]), (3, ""), (4, "")]
    empty = docs.where("false")
    for _, apply in corpus_pipeline.STAGES:
        empty = stage(apply(spark, empty, small), "test-empty")
        assert empty.count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, small):
    words = [f"word{k}" for k in range(60)]
    a, copy, third = " ".join(words), " ".join([*words, "more"]), " ".join([*words, "last"])
    b, c = "something else that nobody copied at all", " ".join(reversed(words))
    # 8: near copies under one id, one of them with the same shingles
    own = [c, c + " more", c.upper()]
    given = [(3, a), (5, copy), (5, b), (6, third), *((8, text) for text in own), (None, copy), (9, "")]
    rows = [(k, text, "en", "s", len(text)) for k, text in given]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, docs, small).collect()]
    assert sorted(one for one in kept if one[0] not in (8, None)) == [(3, a), (5, b), (9, "")]
    assert len([text for k, text in kept if k == 8 and text in own]) == 1
    assert [text for k, text in kept if k is None] == [copy]
