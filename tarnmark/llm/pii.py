"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans. The field adds spans that they miss (two card
numbers side by side, a number with one separator too many): it scores whole
candidate segments, not tokens, by features of the span (digit groups, Luhn
sum, octet range, separators, what stands on either side), and a dynamic
program over segments of bounded length chooses boundaries and types jointly.
Text without a digit or an at sign has no candidate segment and scores zero
everywhere, so the program runs over the windows around those only; that is
exact, not a cut: a window ends only where no candidate segment can cross, and
for a long one the program keeps borders and best scores, not candidates.

The field is trained here, by gradient steps on its conditional likelihood, on
generated windows, with numbers of every length that are none of these;
training is deterministic and takes seconds, once a driver. An added card has 14
to 19 digits. Digits in blanks alone cannot tell cards side by side from other
groups: where six groups of four are no cards, a run of four passes the Luhn sum
by chance in a quarter of all cases, and is then taken for one.

Positions count code points; ends are exclusive. Defined results: null and
empty texts have no spans; overlapping kinds of the base are all kept; an added
span that touches a base span is dropped; repeated rows are scanned each; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import per_batch, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Atoms and characters that a candidate segment has at most.
MAX_ATOMS, MAX_CHARS = 24, 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str):
    """As the whole pattern finds them; each at sign is tried once, with the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# ------------------------------------------------------------------ the field

_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.S)
_TRIGGER = re.compile(r"[0-9@]+")
#: Further characters that count as digits of a candidate; searched for only in texts that have one.
_DIGITS = frozenset(c for c in map(chr, range(128, 0x20000)) if c.isdigit())
_ANY_TRIGGER = re.compile("[0-9@" + "".join(sorted(_DIGITS)) + "]+")
_ENDS = frozenset("0123456789+(") | _LOCAL - frozenset(".%-")


def windows(text: str):
    """(start, end) around digits and at signs; every candidate segment lies in one, and none ends inside an atom."""
    start = end = None
    for m in (_TRIGGER if text.isascii() or _DIGITS.isdisjoint(text) else _ANY_TRIGGER).finditer(text):
        a, b = m.span()
        low = max(0, b - MAX_CHARS)
        low = max(low, text.rfind("\n", low, a) + 1)
        # a number starts with a digit, a bracket or a plus
        first = min((x for x in (text.find("(", low, a), text.find("+", low, a)) if x >= 0), default=a)
        if "@" in m[0]:  # what an address can reach: no blank, whole atoms
            low, high = max(0, a - MAX_CHARS), min(len(text), b + MAX_CHARS)
            first = min(first, max(low, text.rfind(" ", low, a) + 1, text.rfind("\n", low, a) + 1))
            b = min(x for x in (high, text.find(" ", b, high), text.find("\n", b, high)) if x >= 0)
        gap = start is not None and m.start() - last < MAX_CHARS and text.find("\n", last, m.start()) < 0
        last = m.end()
        while 0 < first and _is_letter(text[first]) and _is_letter(text[first - 1]) and (start is None or first > end or first <= start):
            first -= 1
        while b < len(text) and _is_letter(text[b]) and _is_letter(text[b - 1]):
            b += 1
        if start is None:
            start, end = first, b
        elif gap or first <= end:
            start, end = min(start, first), max(end, b)
        else:
            yield start, end
            start, end = first, b
    if start is not None:
        yield start, end


def _is_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def span_features(text: str, start: int, end: int, kind: int) -> list[str]:
    """Features of the whole segment text[start:end] as one of KINDS."""
    span, before, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    k = KINDS[kind]
    digits = _NOT_DIGIT.sub("", span)
    out = [f"{k}|bias"]
    if before and before in _LOCAL:
        out.append(f"{k}|left-joined")
    if after and (after.isalnum() or (after == "@")):
        out.append(f"{k}|right-joined")
    if kind == 0:
        local, _, domain = span.partition("@")
        labels = domain.split(".")
        out.append(f"{k}|shape={int(bool(local) and span.count('@') == 1)}{int(len(labels) > 1 and all(labels))}")
        out.append(f"{k}|top={'letters' if labels[-1].isalpha() and len(labels[-1]) > 1 else 'other'}")
        return out
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    marks = set(re.sub(r"[0-9]", "", span))
    out.append(f"{k}|marks={'none' if not marks else 'dot' if marks == {'.'} else 'space-dash' if marks <= set(' -') else 'phone' if marks <= set('+() .-') else 'other'}")
    if kind == 1:
        out.append(f"{k}|groups={len(groups) == 4}|dots={span.count('.') == 3 == len(span) - len(digits)}")
        out.append(f"{k}|octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    elif kind == 2:
        out.append(f"{k}|luhn={luhn(digits)}")
        out.append(f"{k}|groups={'one' if len(groups) == 1 else 'even' if len({len(g) for g in groups[:-1]}) == 1 and len(groups[0]) == 4 else 'odd'}")
    else:
        out.append(f"{k}|plus={span[0] == '+'}|size={'ok' if 10 <= len(digits) <= 15 else 'off'}")
        out.append(f"{k}|brackets={span.count('(') == span.count(')')}")
        out.append(f"{k}|groups={'few' if 2 <= len(groups) <= 6 else 'other'}")
    return out


def atom_borders(text: str, start: int, end: int) -> list[int]:
    return [start] + [m.end() for m in _ATOM.finditer(text, start, end)]


def segments_at(text: str, borders: list[int], i: int):
    """(last border, kind) of the candidate segments from border i."""
    a = borders[i]
    first = text[a]
    if first not in _ENDS:
        return
    number = first.isdigit() or first in "+("
    if not number and text.find("@", a, a + MAX_CHARS) < 0:
        return
    for j in range(i + 1, min(len(borders), i + 1 + MAX_ATOMS)):
        b = borders[j]
        if b - a > MAX_CHARS or "\n" in text[borders[j - 1] : b]:
            break
        last, span = text[b - 1], text[a:b]
        if not last.isalnum():
            continue
        if "@" in span:
            if " " not in span and span[0] != "(":
                yield j, 0
        elif number and last.isdigit() and "." in span and span.count(".") == 3 and first.isdigit():
            yield j, 1
        if number and last.isdigit():
            n = sum(c.isdigit() for c in span)
            if first.isdigit() and 14 <= n <= 19:
                yield j, 2
            if 9 <= n <= 16:
                yield j, 3


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Atom borders of a window and its candidate segments (first border, last border, kind)."""
    borders = atom_borders(text, start, end)
    return borders, [(i, j, kind) for i in range(len(borders) - 1) for j, kind in segments_at(text, borders, i)]


class SemiMarkovField:
    """Weights of span features, and of a segment that follows another at once."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def _scored(self, text: str, start: int, end: int):
        borders, found = candidates(text, start, end)
        get = self.weights.get
        by_end: dict[int, list[tuple[int, int, float, list[str]]]] = {}
        for i, j, kind in found:
            names = span_features(text, borders[i], borders[j], kind)
            by_end.setdefault(j, []).append((i, kind, sum(get(x, 0.0) for x in names), names))
        return borders, by_end

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """The best segmentation of a window: (start, kind number, end) of its entities."""
        borders, get = atom_borders(text, start, end), self.weights.get
        n, touch = len(borders), self.weights.get("touch", 0.0)
        plain, entity = [0.0] * n, [-math.inf] * n  # best that ends here after plain text, after an entity
        back_plain, back_entity = [False] * n, [None] * n
        for i in range(n - 1):
            if i:
                back_plain[i] = entity[i - 1] > plain[i - 1]
                plain[i] = max(plain[i - 1], entity[i - 1])
            after = entity[i] + touch
            for j, kind in segments_at(text, borders, i):
                here = sum(get(x, 0.0) for x in span_features(text, borders[i], borders[j], kind)) + max(plain[i], after)
                if here > entity[j]:
                    entity[j], back_entity[j] = here, (i, kind, after > plain[i])
        if n > 1:
            back_plain[n - 1] = entity[n - 2] > plain[n - 2]
            plain[n - 1] = max(plain[n - 2], entity[n - 2])
        out, j, in_entity = [], n - 1, entity[n - 1] > plain[n - 1]
        while j > 0:
            if in_entity:
                i, kind, in_entity = back_entity[j]
                out.append((borders[i], kind, borders[j]))
                j = i
            else:
                in_entity, j = back_plain[j], j - 1
        return out[::-1]

    def gradient(self, text: str, gold: list[tuple[int, int, int]]) -> dict[str, float]:
        """Observed minus expected feature counts over the segmentations of a text."""
        borders, by_end = self._scored(text, 0, len(text))
        n, touch = len(borders), self.weights.get("touch", 0.0)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        fp, fe, bp, be = [0.0] * n, [-math.inf] * n, [-math.inf] * n, [-math.inf] * n
        for j in range(1, n):
            fp[j] = add(fp[j - 1], fe[j - 1])
            for i, _, score, _ in by_end.get(j, ()):
                fe[j] = add(fe[j], score + add(fp[i], fe[i] + touch))
        bp[n - 1] = be[n - 1] = 0.0  # log sums of what follows, after plain text and after an entity
        starts: dict[int, list] = {}
        for j, ends in by_end.items():
            for i, kind, score, names in ends:
                starts.setdefault(i, []).append((j, kind, score, names))
        for i in range(n - 2, -1, -1):
            bp[i] = be[i] = bp[i + 1]
            for j, _, score, _ in starts.get(i, ()):
                bp[i], be[i] = add(bp[i], score + be[j]), add(be[i], touch + score + be[j])
        total, out = add(fp[n - 1], fe[n - 1]), {}
        wanted = set(gold)
        for i, segments in starts.items():
            for j, kind, score, names in segments:
                alone = math.exp(min(0.0, fp[i] + score + be[j] - total))
                touching = math.exp(min(0.0, fe[i] + touch + score + be[j] - total)) if fe[i] > -math.inf else 0.0
                change = ((borders[i], kind, borders[j]) in wanted) - alone - touching
                for name in names:
                    out[name] = out.get(name, 0.0) + change
                out["touch"] = out.get("touch", 0.0) - touching
        return out


def _with_luhn(rng: random.Random, n: int, valid: bool) -> str:
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    check = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (check if valid else rng.choice([c for c in "0123456789" if c != check]))


def training_windows(n: int = 1400, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with personal data, alone and side by side, and numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 7)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def entity() -> tuple[int | None, str]:
        pick = rng.random()
        if pick < 0.18:
            return 0, f"{word()}.{num(2)}@{word()}{rng.choice(['', num(1)])}.{rng.choice(['com', 'example.org', 'de', 'net'])}"
        if pick < 0.36:
            return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if pick < 0.56:
            digits = _with_luhn(rng, 16, True)
            join = rng.choice(["", "", " ", "-"])
            return 2, join.join(digits[i : i + 4] for i in range(0, 16, 4))
        if pick < 0.72:
            return 3, rng.choice([f"+1 ({num(3)}) 555-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"+{num(2)}-{num(4)}-{num(6)}"])
        size = rng.randint(1, 24)  # a number of any length, a checksum that holds only where no card has that length
        bare = _with_luhn(rng, size, not 14 <= size <= 19 and rng.random() < 0.5) if size > 1 else num(1)
        digits = _with_luhn(rng, rng.randint(14, 19), False)
        return None, rng.choice(
            [bare, bare, bare, f"1{num(12)}", f"{num(13)}", "-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), " ".join(digits[i : i + 4] for i in range(0, len(digits), 4)),
             f"{num(1)}.{num(1)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
             f"{word()}{num(rng.randint(3, 15))}{word()}", f"{num(5)}/{num(6)}-{num(4)}", f"{num(rng.randint(3, 9))} {num(rng.randint(3, 9))}",
             f"{rng.randint(256, 999)}.{num(2)}.{num(2)}.{num(3)}", f"{word()}@{word()}", f"({num(3)}) {num(3)}-{num(4)}"]
        )

    out = []
    for _ in range(n):
        text, gold = word() + " ", []
        for _ in range(rng.choice([1, 1, 2])):
            kind, span = entity()
            if kind is not None:
                gold.append((len(text), kind, len(text) + len(span)))
            text += span + rng.choice([" ", ", ", f" {word()} "])
        out.append((text + word(), gold))
    return out


@functools.cache
def trained() -> SemiMarkovField:
    """The field, trained by AdaGrad on the generated windows."""
    field, squares = SemiMarkovField({"touch": -1.0}), {}
    data = training_windows()
    for _ in range(4):
        for text, gold in data:
            for name, g in field.gradient(text, gold).items():
                g -= 0.002 * field.weights.get(name, 0.0)
                squares[name] = squares.get(name, 1e-6) + g * g
                field.weights[name] = field.weights.get(name, 0.0) + 0.5 * g / math.sqrt(squares[name])
    return field


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those the field adds apart from them; both sorted."""
    base, added, i = base_spans(text), [], 0
    ends = 0
    taken = []  # base spans as disjoint stretches
    for s, _, e in base:
        if taken and s < ends:
            taken[-1][1] = ends = max(ends, e)
        else:
            taken.append([s, e])
            ends = e
    for start, end in windows(text):
        for s, kind, e in field.decode(text, start, end):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i == len(taken) or e <= taken[i][0]:
                added.append((s, kind, e))
    return base, added


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, field: SemiMarkovField | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row of docs."""
    field = field or trained()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, shas, spans, added_n = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                base, added = find_spans(text, field)
                for k, c in enumerate(counts):
                    c.append(sum(1 for x in base if x[1] == k))
                shas.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(sorted(base + added)))
                added_n.append(len(added))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(spans, pa.string()), pa.array(added_n, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(per_batch(make), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def mask(text: str | None, field: SemiMarkovField) -> str | None:
    """The text with each stretch of personal data replaced by its kind in brackets."""
    if not text:
        return text
    base, added = find_spans(text, field)
    out, at = [], 0
    for s, k, e in sorted(base + added):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, field: SemiMarkovField | None = None) -> DataFrame:
    """docs with personal data in ``text`` masked; other columns stay as they are."""
    field = field or trained()
    at = docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([mask(t, field) for t in batch.column(at).to_pylist()], batch.column(at).type)
            return pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

        return step

    return docs.mapInArrow(per_batch(make), docs.schema)


def personal_data_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: all documents."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
