"""Links by expressions and by pieces against the plain reader."""

import random

import pytest

from tarnmark.functions.markdown import parse_note
from tarnmark.operators.long_bodies import links_by_pieces
from tarnmark.operators.parsing import PARSED, parse_notes

BITS = [
    "[", "]", "(", ")", "!", "[[", "]]", "](", "a", "b.md", "x/../c.md", "../d.md", "[up](../../d'.md)", "[up](.././g\\.md#x)", "/e.md", "#p", "|", " ", "\t", "\n", "\r\n",
    "\r", "\x0b", "\x1f", "\u2028", "\u2029", "\x85", "\xa0", "```", "~~~", "   ```", "\n```\n", "\n~~~\n", '"t"', ' "see [[x]]"', "[a](b.md)", "[[Q]]", "[[B.MD#s|Sh]]",
    "\\", "'", '"', "\u00e9", "\U0001f600", "\u017f", "https://x/y.md", '[l](b[[z]].md "u")', "^", "```x",
]
HEADS = [
    *["---\ntype: x\n---\n"] * 8, "---\r\ntype: x\r\n---\r\n", "---\r---\n", "---\ntype: x\n---", "", "---", "---\n- a\n---\n", "---\ntype: x\ntitle: 3\n---\n",
    "---\ntype: x\ntimestamp: 2026-07-01T09:30:00+02:00\nzz: {a: 1}\n---\n", "---\ntype: x\ntags: [a, b]\n\x0b---\n",
]


def test_notes_read_in_spark_are_those_read_in_python(spark):
    pick = random.Random(5)
    notes = []
    for i in range(1500):
        body = "".join(pick.choice(BITS) for _ in range(pick.randrange(0, 40)))
        notes.append((pick.choice(["a", "x/b", "x/y/c"]), f"p{i}", pick.choice(HEADS) + body, None))
    notes += [("q", "null", None, None), ("q", "given", "x", "unreadable"), ("q", "blank reason", "---\ntype: x\n---\n[[a]]", "")]
    got = {x.path: x.asDict(True) for x in parse_notes(spark.createDataFrame(notes, "id string, path string, raw string, reason string")).collect()}
    assert len(got) == len(notes)
    for note_id, path, raw, reason in notes:
        found = {"reason": reason} if reason else parse_note(raw or "", note_id)
        assert got[path] == {f.name: None for f in PARSED} | {"id": note_id, "path": path, "raw": raw} | found


def _plain(rows):
    links, bad = [], []
    for note_id, body in rows:
        found = parse_note("---\ntype: x\n---\n" + (body or ""), note_id)
        if found["reason"]:
            bad.append((note_id, found["reason"]))
        else:
            links += [(note_id, *e.values()) for e in found["links"]]
    return sorted(links), sorted(bad)


@pytest.mark.parametrize("piece_chars", [1, 40])
def test_pieces_give_the_links_of_whole_bodies(spark, piece_chars):
    pick = random.Random(9)
    lines = ["[a](b.md) x [[Q|z]]\n", "```\n", "~~~\n", "   ```py\n", "word word\r\n", "\n", "[[T]]", "\u00e9\U0001f600 [u](c.md) ", "```"]
    rows = [(f"n/{i}", "".join(pick.choice(lines) for _ in range(pick.randrange(0, 60)))) for i in range(100)]
    rows += [("n/null", None), ("n/empty", ""), ("n/out", "a\n" * 50 + "[u](../../o.md)\n[v](../../p.md)"), ("n/twice", "[a](b.md)\n"), ("n/twice", "[a](b.md)\n")]
    links, invalid = links_by_pieces(spark.createDataFrame(rows, "id string, body string"), piece_chars)
    assert (sorted(map(tuple, links.collect())), sorted(map(tuple, invalid.collect()))) == _plain(rows)


def test_one_long_body_is_read_by_several_tasks(spark):
    block = "word " * 300 + "[a](b.md)\n```\n[hidden](c.md)\n~~~\n"
    body = (block + "```\n") * 2000 + "```\n[[gone]]"  # 3 MB, and code that stays open
    links, invalid = links_by_pieces(spark.createDataFrame([("n", body)], "id string, body string"), 1 << 16)
    assert invalid.isEmpty()
    rows = links.orderBy("edge_pos").collect()
    assert [(r.edge_pos, r.target_id) for r in rows] == [(i, "b") for i in range(2000)]
    assert links.inputFiles() and spark.read.parquet(links.written_to).count() == 2000


def test_no_bodies_and_bad_pieces(spark):
    links, invalid = links_by_pieces(spark.createDataFrame([], "id string, body string, text string, piece int"))
    assert links.isEmpty() and invalid.isEmpty()
    with pytest.raises(ValueError, match="piece_chars"):
        links_by_pieces(spark.createDataFrame([], "id string, body string"), 0)
