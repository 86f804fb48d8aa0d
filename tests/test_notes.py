"""Parsing of notes: truth tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarnmark.functions.markdown import Invalid, check_metadata, index_heading, internal_target, links, open_stretches, parse_note, split_note, wiki_key
from tarnmark.functions.text import casefold, escapes, lines, link_target, normal_path, snippet, strip, tokens, uuid5


@pytest.mark.parametrize("raw", ["", "no metadata", " ---\ntype: x\n---\n", "﻿---\ntype: x\n---\n", "----\ntype: x\n---\n"])
def test_missing_opening(raw):
    assert parse_note(raw, "a")["reason"] == "missing opening '---' frontmatter delimiter"


def test_delimiters_and_body():
    assert split_note("---\ntype: x\n---\nbody\n") == ({"type": "x"}, "body\n")
    assert split_note("---\r\ntype: x\r\n---\r\nbody\r\n") == ({"type": "x"}, "body\r\n")
    assert split_note("---\n---\nbody") == ({}, "body")
    assert split_note("---\ntype: x\n---") == ({"type": "x"}, "")
    assert parse_note("---\ntype: x\nbody", "a")["reason"] == "missing closing '---' frontmatter delimiter"
    assert parse_note("---\n- a\n---\n", "a")["reason"] == "frontmatter must be a YAML mapping"
    assert parse_note("---\ntype: [\n---\n", "a")["reason"].startswith("malformed YAML frontmatter: ")


@pytest.mark.parametrize(
    "meta", ["title: x", "type: ''", "type: '  '", "type: 123", "type: on", "type: x\ntags: one", "type: x\ntags: [1]", "type: x\ntitle: [a]",
             "type: x\ntimestamp: true", "type: x\ntimestamp: soon", "type: x\n1: y", "type: x\nd: 2026-13-45"]
)
def test_invalid_metadata(meta):
    assert parse_note(f"---\n{meta}\n---\n", "a")["reason"]


def test_metadata_values():
    m = check_metadata({"type": " t ", "tags": None, "aliases": ["a"], "timestamp": datetime.date(2026, 7, 1), "owner": "me", "n": {"k": 1}})
    assert (m["type"], m["tags"], m["aliases"], m["timestamp"], m["extra"]) == (" t ", [], ["a"], datetime.datetime(2026, 7, 1), {"owner": "me", "n": {"k": 1}})
    aware = parse_note("---\ntype: x\ntimestamp: 2026-07-01T09:30:00+02:00\n---\n", "a")
    assert (aware["ts_iso"], aware["ts_offset_s"]) == ("2026-07-01T09:30:00+02:00", 7200)


TARGETS = [
    ("b.md", "x/a", "x/b"), ("./b.md", "x/a", "x/b"), ("../b.md", "x/a", "b"), ("/b.md", "x/a", "b"), ("/y/b.md#part", "x/a", "y/b"),
    ("b.md#part", "a", "b"), ("y/../b.md", "x/a", "x/b"), ("#part", "a", None), ("b.MD", "a", None), ("b.txt", "a", None), ("b", "a", None),
    ("https://e.com/b.md", "a", None), ("mailto:b.md", "a", None), ("//e.com/b.md", "a", None), ("b.md?x", "a", None), ("my%20b.md", "a", "my%20b"),
]


@pytest.mark.parametrize("target,source,want", TARGETS)
def test_link_targets(target, source, want):
    assert internal_target(target, source) == want


def test_link_targets_in_the_jvm(spark):
    df = spark.createDataFrame([(t, s) for t, s, _ in TARGETS], "t string, s string")
    assert [r.x for r in df.select(link_target(F.col("t"), F.col("s")).alias("x")).collect()] == [w for _, _, w in TARGETS]


@pytest.mark.parametrize("target,source", [("../b.md", "a"), ("../../b.md", "x/a"), ("/../b.md", "x/a"), ("y/../../b.md", "a")])
def test_escaping_targets(target, source, spark):
    with pytest.raises(Invalid, match="escapes the bundle"):
        internal_target(target, source)
    assert spark.range(1).select(escapes(link_target(F.lit(target), F.lit(source))).alias("x")).first().x


@pytest.mark.parametrize(
    "inner,key,shown",
    [("Note", "note", "Note"), ("Note|Shown", "note", "Shown"), ("Note#Part", "note", "Note#Part"), ("Note^b1", "note", "Note^b1"), ("Note#P|S", "note", "S"),
     ("f/Note.md", "f/note", "f/Note.md"), ("NOTE.MD", "note", "NOTE.MD"), (" Note ", "note", "Note"), ("#Part", "", "#Part"), ("Straße", "strasse", "Straße")],
)
def test_wiki_targets(inner, key, shown):
    assert wiki_key(inner) == (key, shown)


def test_links_in_document_order():
    text = '[a](a.md) [[W]] ![i](i.md) ![[E]] [b](b.md "t [[N]]")\n```\n[c](c.md)\n~~~\n```\n~~~\n[d](d.md)\n```\n~~~\n[e](e.md) [e](e.md) [[#x]]'
    assert [(e["edge_pos"], e["target_id"], e["link_kind"]) for e in links(text, "n")] == [
        (0, "a", "markdown"), (1, "w", "wiki"), (2, "b", "markdown"), (3, "n", "wiki"), (4, "e", "markdown"), (5, "e", "markdown"),
    ]
    assert links("```\n[a](a.md)", "n") == []


def test_index_heading():
    assert index_heading("# Top ##\n\n- [a](a.md)\n\nFirst line\n- more\n\nnext") == ("Top", "First line - more")
    assert index_heading("---\ntitle: x\n---\n\n# T\n") == (None, "--- title: x ---")
    assert index_heading("```\n# no\n```\n## two\n") == (None, None)
    assert index_heading("~~~\n# a\n```\n# B #\n\n1) x\npart one\n * part two\n```\nmore\n") == ("B", "part one * part two")
    assert index_heading("") == (None, None) and index_heading("```\nx") == (None, None)


def test_open_stretches():
    text = "a\n```x\nb\n~~~\n   ```\nc\x0b~~~\nd"
    assert open_stretches(text) == ["a\n", "c\x0b", ""]
    assert open_stretches(text, paired=False) == ["a\n", "", "d"]
    assert open_stretches("    ```\nx") == ["    ```\nx"]


def test_text_functions(spark):
    values = ["Straße ΟΔΟΣ", "Ωmega ﬁn", "a\x0bb c\r\nd\n", " \t x　", "café naïve_1 ñ", "# h\n  text  of\n## g\nend", "", "y" * 300]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(casefold(F.col("v")).alias("f"), lines(F.col("v")).alias("l"), strip(F.col("v")).alias("s"), tokens(F.col("v")).alias("t"), snippet(F.col("v")).alias("n")).collect()
    import re

    for v, r in zip(values, got):
        prose = " ".join(" ".join(x for x in v.splitlines() if not x.lstrip().startswith("#")).split())
        assert (r.f, r.l, r.s, r.t) == (v.casefold(), v.splitlines(), v.strip(), re.findall(r"\w+", v.casefold()))
        assert r.n == (prose if len(prose) <= 200 else prose[:200].rstrip() + "...")


def test_uuid_and_paths(spark):
    import uuid

    row = spark.range(1).select(uuid5(uuid.NAMESPACE_URL, F.lit("a\x00é")).alias("u"), normal_path(F.lit("a/./b/../../../c")).alias("p"), normal_path(F.lit("a/..")).alias("e")).first()
    assert (row.u, row.p, row.e) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "a\x00é")), "../c", ".")


def test_snippets_end_early_only_where_nothing_can_change(spark):
    rows = [("a " * 90 + " \n" * 5000 + "# no\n" + "b" * 9,), ("# t\n x  y\r\n\x1c #z\n",), (("word " * 40 + "\n") * 20000,), (None,), ("# all\n#more",), ("x" * 200 + " ",), ("x" * 200 + " y",)]
    df = spark.createDataFrame(rows, "t string").repartition(1)
    got = [r.s for r in df.select(snippet(F.col("t")).alias("s")).collect()]
    assert got == ["a " * 90 + "b" * 9, "x y", ("word " * 40).rstrip() + "...", None, "", "x" * 200, "x" * 200 + "..."]
    plan = df.select(snippet(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # lines are not cut one by one


def test_links_are_looked_for_in_lines_that_have_brackets(spark):
    from tarnmark.functions import link_text

    body = "no\n[a](a.md)\r\nwords ](x.md) ![i](i.md) [b](b.md)\x0b[c\nd](e.md)\n```\n[h](h.md)\n```\n!\n[[W]]"
    df = spark.createDataFrame([(body,), (None,), ("none",)], "t string").repartition(1)
    got = df.select(link_text.linking_lines(link_text.visible(F.col("t"))).alias("v"), link_text.links(F.col("t"), F.lit("n")).target_id.alias("x")).collect()
    assert sorted(((r.v, r.x) for r in got), key=str) == sorted([("[a](a.md)\n![i](i.md) [b](b.md)\n[c\n[[W]]", ["a", "b", "w"]), (None, None), ("", [])], key=str)
