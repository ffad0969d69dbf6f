"""Proofs beside a manifest built row by row in plain Python."""

import hashlib
import zlib

import pytest

from coterie.llm import merkle
from coterie.llm.merkle import Manifest, prove, prove_documents

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climb(nodes, at, value):
    """(siblings of ``at``, the top that ``value`` gives there, the top)."""
    beside = []
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        run, place = runs[at // 16], at % 16
        beside += run[:place] + run[place + 1 :]
        value = sha("".join(run[:place] + [value] + run[place + 1 :]))
        nodes, at = [sha("".join(run)) for run in runs], at // 16
    return beside, value, nodes[0]


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        mine = [(r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[3] == source]
        trees[source] = sorted(mine, key=lambda x: x[:3])
    tops = [climb([x[2] for x in trees[s]], 0, "")[2] for s in sources]
    out = []
    for k, source in enumerate(sources):
        nodes = [x[2] for x in trees[source]]
        for place, (known, _, own, row) in enumerate(trees[source]):
            bad = known and zlib.crc32(str(row[0]).encode()) % 5 == 0
            first, value, _ = climb(nodes, place, leaf(row, True) if bad else own)
            second, value, root = climb(tops, k, value)
            out.append((row[0], own, tops[k], root, sha("".join(first + second)), value, value == root))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def documents(n):
    rows = [(k, f"Text {k} É", "en", "hot" if k % 3 else f"s{k % 40}", k) for k in range(n)]
    rows += [(None, "x", None, None, None), (7, None, "en", None, 3), (8, "", "", "", 0)]
    rows += [(5, "Same", "en", "hot", 4)] * 3 + [(5, "same", "en", "hot", 4), (-10, "NEG", "en", "alone", 3)]
    return rows


@pytest.mark.parametrize("bits", [4, 8, 12])
def test_proofs_match_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", bits)
    rows = documents(700)
    docs = spark.createDataFrame(rows, SHAPE).repartition(5)
    result = prove_documents(docs)
    assert found(result) == brute(rows)
    assert {True, False} == {r.verified for r in result.collect()}


def test_proofs_of_some_rows_hold_their_siblings(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 6)
    rows = documents(300)
    manifest = Manifest(spark.createDataFrame(rows, SHAPE))
    some = prove(manifest, manifest.leaves.where("doc_id % 17 = 3 or source = 'alone'")).collect()
    expected = [r for r in brute(rows) if r[0] is not None and (r[0] % 17 == 3 or r[0] == -10)]
    assert sorted([(r.doc_id, r.leaf, r.proof_sha256, r.folded_root) for r in some]) == sorted(
        [(r[0], r[1], r[4], r[5]) for r in expected]
    )
    assert all(sha("".join(r.siblings)) == r.proof_sha256 for r in some)


def test_fewest_nodes():
    # of 40 leaves, a whole run and one more leaf: its 15 neighbours and the third run
    assert sorted(merkle.missing({*range(16), 20}, 40)) == [(0, p) for p in range(16, 32) if p != 20] + [(1, 2)]
    assert not list(merkle.missing({0}, 1))


def test_single_and_no_rows_and_extra_columns(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], SHAPE)
    (row,) = prove_documents(one.selectExpr("*", "1 as leaf", "2 as place", "3 as tree", "4 as root", "5 as size")).collect()
    own = leaf((1, "a", "en", "s", 1))
    assert tuple(row) == (1, own, own, own, sha(""), own, True)
    assert prove_documents(one.limit(0)).collect() == []


def test_long_texts_and_one_source(spark):
    rows = [(k, "Word " * 200_000 if k == 3 else None, None, "only", None) for k in range(33)]
    assert found(prove_documents(spark.createDataFrame(rows, SHAPE))) == brute(rows)
