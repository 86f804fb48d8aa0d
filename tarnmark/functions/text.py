"""String functions that Spark lacks, as expressions that stay in the JVM."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What Python's splitlines takes for the end of a line (fixed values).
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Letters, numbers and the underscore, as Python's \w.
WORD = r"[\p{L}\p{N}_]+"
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space that is more than one blank, or another; a heading with the line end before it.
_SPACES = f"[[^!-~]&&{_SPACE}](?:(?<! )|{_SPACE}){_SPACE}*"
_HEADING = r"(?:\A|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*#[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*"


@functools.cache
def _folds() -> dict[str, str]:
    """What Spark's lower() leaves that case folding changes; asked of the session once, as it depends on its Unicode version."""
    changed = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and c.casefold() != c]
    lowered = SparkSession.getActiveSession().range(1).select(F.lower(F.lit("\n".join(changed))).alias("x")).first().x
    return {c: c.casefold() for c in sorted(set(lowered)) if c.casefold() != c} | {"\u03c2": "\u03c3"}


def _ranges(chars: list[str]) -> str:
    """A character class of the ranges that the sorted characters form."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def casefold(column: Column) -> Column:
    """Python's str.casefold: lower case, then the few characters that fold further, each replaced at once."""
    folds = _folds()
    special = f"[[^\\x00-\\x7F]&&{_ranges(list(folds))}]"  # the long class is asked of characters beyond ASCII only
    table = F.create_map(*[F.lit(x) for pair in folds.items() for x in pair])

    def fold(low: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"({special})"), F.lit(1)))
        return F.when(low.rlike(special), F.aggregate(found, low, lambda text, c: F.replace(text, c, F.element_at(table, c)))).otherwise(low)

    return F.get(F.transform(F.array(F.lower(column)), fold), F.lit(0))  # bound to a lambda: lower case once


def lowercase(column: Column) -> Column:
    """Lower case as SQL engines have it, each code point by itself: Spark's, but that İ becomes i, and Σ becomes σ at the end of a word too."""
    return F.lower(F.replace(F.replace(column, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def tokens(column: Column, fold: bool = True) -> Column:
    """Case-folded word tokens, in order, repeats kept."""
    return F.regexp_extract_all(casefold(column) if fold else column, F.lit(f"({WORD})"), F.lit(1))


def strip(column: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(column, f"^{_SPACE}+|{_SPACE}+$", "")


def lines(column: Column) -> Column:
    """As Python's splitlines: no empty last line."""
    parts = F.split(column, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def normal_path(column: Column) -> Column:
    """posixpath.normpath of a relative path: folds over the segments."""
    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & up, F.slice(done, 1, F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    empty = F.array().cast("array<string>")
    folded = F.aggregate(F.split(column, "/"), empty, lambda done, part: F.when(F.size(done) == 0, F.when(part.isin("", "."), done).otherwise(F.array(part))).otherwise(step(done, part)))
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def link_target(target: Column, source_id: Column) -> Column:
    """The concept id that an inline link names; null if it is no internal Markdown link.

    A result that starts with ``..`` leaves the bundle; see ``escapes``.
    """
    path = F.substring_index(target, "#", 1)
    folder = F.when(F.instr(source_id, "/") > 0, F.regexp_replace(source_id, "[^/]*$", "")).otherwise(F.lit(""))
    joined = F.when(path.startswith("/"), F.regexp_replace(path, "^/+", "")).otherwise(F.concat(folder, path))
    clean = normal_path(joined)
    internal = ~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~target.startswith("//") & path.endswith(".md")
    return F.when(internal, F.substring(clean, F.lit(1), F.length(clean) - 3))


def escapes(target_id: Column) -> Column:
    return target_id.startswith("../")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Version 5 UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def snippet(column: Column, limit: int = 200) -> Column:
    """Prose of a Markdown text on one line: headings gone, white space collapsed, cut at ``limit``.

    A line's prose depends on nothing behind it, so where the beginning of a text
    has more than ``limit`` characters of prose, the rest cannot change the snippet.
    """
    def flat(text: Column) -> Column:
        prose = F.when(F.contains(text, F.lit("#")), F.regexp_replace(text, _HEADING, " ")).otherwise(text)
        return F.regexp_replace(F.regexp_replace(prose, _SPACES, " "), "^ | $", "")

    def short(x: Column) -> Column:
        return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, limit), " $", ""), F.lit("...")))

    begun = F.transform(F.array(flat(F.substring(column, 1, 4 * limit))), lambda x: F.when((F.length(x) > limit) & (F.length(column) > 4 * limit), x).otherwise(flat(column)))
    return F.get(F.transform(begun, short), F.lit(0))


def token_estimate(column: Column) -> Column:
    """About four characters for each token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(column) / 4)).cast("long")
