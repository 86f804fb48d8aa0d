"""Repeated rows, missing ids, columns whose names clash with the operators' own, empty tables and long texts."""

import pytest

from tarnmark.llm import license_scan, near_dup, packing, pii, quality
from tarnmark.llm.tokens import public_path

CLASHING = ["spans", "n_email", "base_sha256", "license_id", "dice", "n_units", "licenses", "score", "x", "label", "held_out", "predicted", "n", "id", "key", "kind", "sequence_id", "length", "start", "kept", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    line = license_scan.TEMPLATES["MIT-line"]
    texts = [(1, "write to a.b@c.org"), (1, "write to a.b@c.org"), (2, None), (2, ""), (None, "call +1 555 555 0100"), (3, f"x\n{line}\ny"), (3, f"x\n{line}\ny"), (4, "plain words and no more " * 40)]
    return spark.createDataFrame([(*t, *("c" for _ in CLASHING)) for t in texts], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


def plain(docs):
    return docs.select("doc_id", "text")


def rows(df, columns):
    return sorted((tuple(str(v) for v in r) for r in df.select(columns).collect()))


def test_personal_data(docs):
    names = ["doc_id", "n_email", "n_phone", "spans", "base_sha256"]
    got = rows(pii.personal_data(docs), names)
    assert got == rows(pii.personal_data(plain(docs)), names) and len(got) == 8
    assert [g[1] for g in got if g[0] == "1"] == ["1", "1"] and [g[2] for g in got if g[0] == "None"] == ["1"]
    assert pii.masked(docs).columns == docs.columns
    assert pii.personal_data(docs.limit(0)).count() == pii.masked(docs.limit(0)).count() == 0


def test_licences(spark, docs):
    templates, names = license_scan.template_table(spark), ["doc_id", "license_id", "dice", "n_units"]
    got = rows(license_scan.license_scan(docs, templates), names)
    assert got == rows(license_scan.license_scan(plain(docs), templates), names)
    assert len(got) == 8 and [g[1:] for g in got if g[0] == "3"] == [("MIT-line", "1.0", "1")] * 2
    assert license_scan.license_scan(docs.limit(0), templates).count() == 0


def test_licences_of_equal_coefficient(spark):
    """Of templates that fit as well, the first by name."""
    twin = {"b": "one two three four five six seven eight", "a": "one two three four five six seven eight", "c": "nothing of the kind is written in here today"}
    df = spark.createDataFrame([(1, twin["a"])], "doc_id long, text string")
    r = license_scan.license_scan(df, license_scan.template_table(spark, twin)).first()
    assert (r.license_id, r.dice, r.licenses) == ("a", 1.0, "a,b")


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, "c", "c") for i in (1, 2, 3, 4, 1)], "doc_id long, quality int, score string, text string")
    names = ["doc_id", "held_out", "score", "predicted"]
    got = rows(quality.quality_scores(docs, labels), names)
    assert got == rows(quality.quality_scores(plain(docs), labels.select("doc_id", "quality")), names) and len(got) == 8
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.good_documents(docs, labels.limit(0)).columns == docs.columns


def test_long_texts(spark):
    """One text of a few megabytes among small ones."""
    long = " ".join(f"word{i % 4999} and" for i in range(250_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short one here now")], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    pieces = packing.pack(df, public_path("byte_bpe_50k.json")).collect()
    for i in (1, 2, 3):
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == own[0][2]
    windows = {}
    for r in pieces:
        windows[r.sequence_id] = windows.get(r.sequence_id, 0) + r.length
    assert max(windows.values()) <= 1024
    assert len(windows) <= 1.02 * sum(r.length for r in pieces) / 1024 + 2
