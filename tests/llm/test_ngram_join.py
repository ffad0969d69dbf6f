"""The n-gram join against all pairs."""

import random
import re

from coterie.llm.components import components
from coterie.llm.ngram_join import link_documents

SCHEMA = "doc_id long, text string, n string, item string"


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def plain(rows, size, percent):
    sets = [shingle_set(text, size) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted(
        (
            (doc_id, len(sets[k]), least.get(find(k)) if sets[k] else doc_id)
            for k, (doc_id, _) in enumerate(rows)
        ),
        key=repr,
    )


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


def corpus(seed, copies=12):
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 30, 120, 400]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)[: rng.randrange(2, 9)]:
            rows += [(None, edited(rng, words, share)) for _ in range(rng.randrange(1, copies // 4))]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(None, passage + " " + edited(rng, ["x"] * 40, 1)) for _ in range(15)]
    rows += [(None, ""), (None, None), (None, " \n "), (None, "One"), (None, "one"), (None, "a b c"), (None, "A B\tc")]
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, size, percent):
    docs = spark.createDataFrame([(*row, "x", "y") for row in rows], SCHEMA).repartition(4)
    found = link_documents(docs, size, percent)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr)


def test_matches_all_pairs(spark):
    for seed, size, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed)
        assert result(spark, rows, size, percent) == plain(rows, size, percent)


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (None, "a b c d e"), (None, "z z z z"), (0, "q r s t u"), (5, None)]
    assert result(spark, rows, 4, 85) == plain(rows, 4, 85)


def test_empty_table(spark):
    assert result(spark, [], 4, 85) == []


def test_a_long_chain_of_links(spark):
    """Each document links with its neighbours only."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(40)]
    assert result(spark, rows, 4, 85) == plain(rows, 4, 85)


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(100)] + [(1000, k) for k in range(1001, 1200)] + [(3, 3), (500, None)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    assert found == {k: 0 for k in range(101)} | {k: 1000 for k in range(1000, 1200)}
    assert components(frame.where("false")).collect() == []
