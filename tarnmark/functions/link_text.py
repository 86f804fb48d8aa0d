"""Links of Markdown bodies as expressions: code is cut out, and links found, in the JVM.

Links are marked where they begin, wikilinks and path links each by one
replacement, so that the order of the marks is the order of the links and a
wikilink in the title of a path link counts too. The marks are line ends, which
no text has once its lines end alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmark.functions.text import casefold, escapes, link_target, strip

#: What ends a line, and what is white space within one (fixed values).
ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = " \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: A line that opens or closes code, in a text with a line end before it.
_FENCE = f"[{ENDS}] {{0,3}}(```|~~~)"
#: A fenced block: up to the end of the next line with the same mark, or of the text.
_FENCED = f"(?s){_FENCE}(?:.*?[{ENDS}] {{0,3}}\\1[^{ENDS}]*|.*)"
_WIKI = r"\[\[[^\[\]\n]+\]\]"
_URL = f"[^()\n{BLANKS}]+"
_PATH = rf'\[[^\]\n]*\]\({_URL}(?:[{BLANKS}]+"[^"\n]*")?\)'
_WIKI_MARK, _PATH_MARK = "\u2028", "\u2029"
_MARKS = f"[{_WIKI_MARK}{_PATH_MARK}]"

OPENING = r"\A---(?:\r\n|\r|\n|\z)"
_HEAD = f"(?s)\\A---(?:\r\n|\r|\n)(.*?)(?<=[{ENDS}])---(?:\r\n|\r|\n|\\z)"


def head(raw: Column) -> Column:
    """The metadata of a note with the lines around it; empty if they are not complete."""
    return F.regexp_extract(raw, _HEAD, 0)


def head_source(raw: Column) -> Column:
    return F.regexp_extract(raw, _HEAD, 1)


def after_head(raw: Column) -> Column:
    return F.substring(raw, F.length(head(raw)) + 1, F.length(raw))


def pieces(body: Column, n_chars: int) -> Column:
    """The body cut after lines, each piece of n_chars at least and one line more at most."""
    return F.regexp_extract_all(body, F.lit(f"(?s)(.{{{n_chars},}}?[{ENDS}]|.+)"), F.lit(1))


def fence_marks(piece: Column) -> Column:
    """The marks of all lines that open or close code, in order; whether one does is not known from a piece alone."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), piece), F.lit(_FENCE), F.lit(1))


def fence_state(before: Column, marks: Column) -> Column:
    """The mark of the code that is open after the lines of ``marks``, empty outside code, from the one before them."""
    return F.aggregate(marks, before, lambda at, mark: F.when(at == "", mark).when(at == mark, F.lit("")).otherwise(at))


def visible(body: Column) -> Column:
    """What lies outside fenced code, lines ended by \n, after a line end."""
    text = F.concat(F.lit("\n"), body)
    text = F.when(F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~")), F.regexp_replace(text, _FENCED, "\n")).otherwise(text)
    return F.regexp_replace(text, f"[{ENDS[1:]}]", "\n")


def linking_lines(text: Column) -> Column:
    """The lines of a visible text that may have links, none of which goes beyond its line."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit("["))), "\n")


def _unembedded(shape: str) -> str:
    """The shape where no exclamation mark stands before; the bracket comes first, as that is quickly looked for."""
    return rf"\[(?<!!\[){shape.removeprefix(chr(92) + '[')}"


def link_sources(text: Column) -> Column:
    """Each link of a visible text as it is written, in the order of their beginnings."""
    marked = F.regexp_replace(text, _unembedded(_WIKI), _WIKI_MARK + "$0")
    marked = F.regexp_replace(marked, _unembedded(_PATH), _PATH_MARK + "$0")
    found = F.regexp_extract_all(marked, F.lit(f"{_MARKS}(?=({_WIKI}|{_PATH}))"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, _MARKS, ""))


def _parts(source: Column) -> Column:
    """(wiki, target, shown) of a link as it is written."""
    wiki = F.endswith(source, F.lit("]]"))
    inner = F.substring(source, F.lit(3), F.length(source) - 4)
    target = F.when(wiki, strip(F.substring_index(inner, "|", 1))).otherwise(F.regexp_extract(source, rf"\A\[[^\]]*\]\(({_URL})", 1))
    shown = F.when(wiki, strip(F.regexp_replace(inner, r"(?s)\A[^|]*\|", ""))).otherwise(F.regexp_extract(source, r"\A\[([^\]]*)\]", 1))
    return F.struct(wiki.alias("wiki"), target.alias("target"), shown.alias("shown"))


def _read(x: Column, note_id: Column) -> Column:
    """(target_id, anchor_text, link_kind, written) of the parts of a link; a path that is no note has no target."""
    key = casefold(F.regexp_replace(strip(F.regexp_extract(x.target, r"(?s)\A[^#^]*", 0)), r"(?i)\.md\z", ""))
    return F.struct(
        F.when(x.wiki, key).when(F.contains(x.target, F.lit(".md")), link_target(x.target, note_id)).alias("target_id"),
        x.shown.alias("anchor_text"),
        F.when(x.wiki, F.lit("wiki")).otherwise(F.lit("markdown")).alias("link_kind"),
        F.when(~x.wiki, x.target).alias("written"),
    )


def links(body: Column, note_id: Column) -> Column:
    """Links to notes in document order, not yet resolved: (target_id, anchor_text, link_kind, written)."""
    sources = F.when(F.contains(body, F.lit("[")), link_sources(linking_lines(visible(body)))).when(body.isNotNull(), F.array().cast("array<string>"))
    found = F.transform(F.transform(sources, _parts), lambda x: _read(x, note_id))
    return F.filter(found, lambda x: x.target_id.isNotNull() & ((x.link_kind == "markdown") | (x.target_id != "")))


def numbered(found: Column) -> Column:
    """Links with their places: (edge_pos, target_id, anchor_text, link_kind)."""
    return F.transform(found, lambda x, i: F.struct(i.alias("edge_pos"), x.target_id.alias("target_id"), x.anchor_text.alias("anchor_text"), x.link_kind.alias("link_kind")))


def escape_reason(found: Column) -> Column:
    """Why a note with a link out of the collection cannot be used; null without one. The first one is named."""
    out = F.filter(found, lambda x: (x.link_kind == "markdown") & escapes(x.target_id))
    return F.get(F.transform(F.slice(out, 1, 1), lambda x: F.concat(F.lit("link target escapes the bundle: "), _quoted(x.written))), F.lit(0))


def _quoted(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(doubled, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(single)
