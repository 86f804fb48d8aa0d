"""HTML text, token files, media, personal data, packing: round trips and brute force."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest

from tarnmark.llm import html_text, media, packing, pii, tokens
from tarnmark.llm.tokens import public_path

TEXTS = ["One two, three. Four!", None, "", "  \n\t ", "One two, three. Four!", "Ünïcödé and spaces 　 here.\n\n x", "it's  a\r\ntest...", "<|endoftext|> don't", "word " * 3000, "\x1c \x85a b c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", f"s{i % 2}", 1, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", "s0", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, task long, rank string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library_ids(name, text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files(docs, none):
    manifest = tokens.write_token_files(docs, public_path("word_bpe_49k.json"), end_id=2)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, tuple(r.tokens)) for r in tokens.read_token_files(manifest, with_tokens=True).collect())
    start, want = 0, []
    for i, t in sorted([*enumerate(TEXTS), (4, TEXTS[4])], key=lambda x: x[0]):
        ids = library_ids("word_bpe_49k.json", t, 2)
        want.append((i, start, len(ids), crc(ids), tuple(ids)))
        start += len(ids)
    assert got == sorted(want)
    assert tokens.read_token_files(tokens.write_token_files(none, public_path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_memo_gives_what_the_library_gives(name, keeps, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 40)
    monkeypatch.setattr(tokens, "CORE_WORDS", 10)
    rng = random.Random(5)
    parts = ["word", "Word.", "it's", ",", "...", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "9", "12.", "a,", " ", "$$", "'s", "don't,", "日本", "x.", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "日本語の文章" * 30, "w" * 200, "q" * 90 + "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(parts[:21]) + rng.choice(["", str(rng.random())]) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    encoder = tokens.WordEncoder(public_path(name), keeps)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path(name))
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.core and all(len(w) <= tokens.MEMO_BYTES for w in encoder.memo)


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_merge_model_gives_what_all_steps_give(name, keeps):
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and (c < 0x80 or c >= 0xC0)]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))).encode() for _ in range(3000)]
    words += [rng.choice(["the", "The", "straße", "ÉCOLE", "co", "w" * 300]).encode() for _ in range(20)]
    if keeps:
        words = [b" " * rng.randint(0, 1) + w for w in words]
    encoder = tokens.WordEncoder(public_path(name), keeps)
    assert encoder.direct and all(tokens._PLAIN_WORD.fullmatch(w) for w in words)
    assert encoder._library(words) == encoder._through_all(words)
    odd = [b"it's", "x×y".encode(), b"a1", "日本".encode(), b"a b", b"\n"]
    assert not any(tokens._PLAIN_WORD.fullmatch(w) for w in odd)
    mixed = [*words[:50], *odd, *words[50:90]]
    assert encoder._library(mixed) == encoder._through_all(mixed)


def test_shards_in_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "READ_BYTES", 40)
    lengths = [0, 3, 50, 1, 1, 0, 9, 11, 20]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    np.arange(offsets[-1], dtype="<u2").tofile(tmp_path / "a.bin")
    with open(tmp_path / "a.idx", "wb") as f:
        f.write(np.array([9], "<u8").tobytes() + np.arange(9, dtype="<i8").tobytes() + np.ones(9, "u1").tobytes() + offsets.tobytes())
    shard = tokens.Shard(f"file://{tmp_path}", "a", 16)
    parts = list(shard.parts())
    assert [i for a, b in parts for i in range(a, b)] == list(range(9)) and len(parts) > 3
    for a, b in parts:
        first, last = int(shard.offsets[a]), int(shard.offsets[b])
        assert b - a == 1 or 2 * (last - first) <= 40
        mapped = shard.tokens(first, last).tolist()
        shard_remote = tokens.Shard.__new__(tokens.Shard)
        shard_remote.mapped, shard_remote.dtype = None, shard.dtype
        import pyarrow as pa

        shard_remote.remote = pa.OSFile(str(tmp_path / "a.bin"))
        if last > first:
            assert shard_remote.tokens(first, last).tolist() == mapped == list(range(first, last))


def test_packing(docs, none):
    got = packing.pack(docs, public_path("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = library_ids("byte_bpe_50k.json", t, 0)
        pieces = sorted(by_doc[i], key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in pieces) == len(ids) * (2 if i == 4 else 1)
        assert all(r.doc_tokens == len(ids) and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in pieces)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(none, public_path("byte_bpe_50k.json")).count() == 0


def test_best_fill_is_best():
    rng = random.Random(3)
    for _ in range(200):
        counts, room = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}, rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
        chosen = packing.best_fill(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(sums) and all(n <= counts[x] for x, n in chosen.items())


def test_media(docs, none):
    got = {r.doc_id: r for r in media.digests(media.to_media(docs)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert (got[0].media_sha256, got[0].feature) == (got[4].media_sha256, got[4].feature) and got[1].feature == got[2].feature
    assert media.digests(media.to_media(none)).count() == 0
    stored = media.tensors(media.to_media(docs)).where("doc_id = 8").first()
    assert len(stored.rgb) == 3 * stored.height * stored.width


def test_media_keeps_any_bytes():
    rng = random.Random(1)
    payloads = [media.pad_payload(bytes(rng.choice(pool) for _ in range(n))) for n in (0, 1, 64, 65, 700, 5000) for pool in (range(256), [104], [104, 105], [0, 255], b"etaoin ")]
    found = media.decode_coefficients(media.encode_batch(payloads))
    assert [media.payload_of(*f) for f in found] == payloads
    with pytest.raises(ValueError):
        media.decode_coefficients([b"\xff\xd8\xff\xd9"])


def test_broken_media_are_rows_with_a_reason(spark):
    rng = random.Random(7)
    whole = media.encode_batch([bytes(rng.choice(b"etaoin shrdlu") for _ in range(64 * n)) for n in (1, 9, 40)])
    streams = [(i, w, "old") for i, w in enumerate(whole)] + [(10, None, "old"), (11, b"", "old"), (12, b"\xff\xd8\xff\xd9", "old"), (13, whole[0][:-2], "old")]
    df = spark.createDataFrame(streams, "doc_id long, media binary, rgb string").repartition(2)
    got = {r.doc_id: r for r in media.tensors(df).collect()}
    assert all(got[i].error is None and len(got[i].rgb) == 3 * got[i].height * got[i].width for i in range(3))
    assert got[10].rgb is None and got[10].error is None
    assert all(got[i].rgb is None and got[i].error for i in (11, 12, 13))
    for w in whole:
        for _ in range(120):
            cut = rng.randrange(len(w))
            with pytest.raises(ValueError):
                media.decode_coefficients([w[:cut]])
            (rgb, reason), = media.decode_each([w[:cut] + b"\xff\xd9"])  # a scan cut off before an end marker
            assert (rgb is None) == (reason is not None)
            broken = bytearray(w)
            broken[rng.randrange(len(w))] = rng.randrange(256)
            media.decode_each([bytes(broken)])


def test_pixels_against_plain_loops():
    """A slow inverse transform, upsampling and colour matrix, from the payload bytes."""
    import math

    payload = media.pad_payload(b"Some text, a bit of it. " * 12)
    found = media.decode_coefficients(media.encode_batch([payload]))[0]
    rgb = media.to_rgb(*found)
    units = -(-len(payload) // 64 // 6)
    blocks = [payload[64 * k : 64 * k + 64] for k in range(len(payload) // 64)]
    blocks += [bytes([media.CENTRE]) * 64] * (6 * units - len(blocks))
    scan = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    basis = [[round(4096 * (math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)] for u in range(8)]

    def samples(block):
        f = [[0] * 8 for _ in range(8)]
        for k, (i, j) in enumerate(scan):
            f[i][j] = block[k] - media.CENTRE
        half = [[sum(f[u][v] * basis[v][x] for v in range(8)) for x in range(8)] for u in range(8)]
        return [[min(255, max(0, math.floor(sum(half[u][x] * basis[u][y] for u in range(8)) / 4096**2 + 128.5))) for x in range(8)] for y in range(8)]

    for n in range(units):
        planes = [samples(b) for b in blocks[6 * n : 6 * n + 6]]
        for y in range(16):
            for x in range(16):
                luma, cb, cr = planes[y // 8 * 2 + x // 8][y % 8][x % 8], planes[4][y // 2][x // 2] - 128, planes[5][y // 2][x // 2] - 128
                want = [luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb]
                at = rgb[y + 16 * (n // found[0].columns), x + 16 * (n % found[0].columns)]
                assert all(abs(int(a) - min(255, max(0, w))) <= 1 for a, w in zip(at, want))
    flat = rgb.reshape(-1, 3).tolist()
    feature = f"{rgb.shape[1]}x{rgb.shape[0]}"
    for c in range(3):
        mean = sum(p[c] for p in flat) / len(flat)
        feature += f";{mean:.3f},{(sum(p[c] ** 2 for p in flat) / len(flat) - mean**2) ** 0.5:.3f}"
    assert media.feature_of(rgb) == feature


def slow_progressive(coefficients, restart=0):
    """A grey 8-wide progressive stream with successive approximation, bit by bit, as the format describes it."""
    n, ac_lengths = len(coefficients), {16 * r + s: 8 for r in range(16) for s in range(1, 9)} | {0xF0: 8} | {r << 4: 8 for r in range(15)}
    dc_body, dc_codes = media.huffman_table(media.DC_LENGTHS)
    ac_body, ac_codes = media.huffman_table(ac_lengths)

    def pack(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    code = lambda table, s: format(table[s][0], f"0{table[s][1]}b")
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([1]) * 64) + media._segment(0xC2, bytes([8, 0, 8 * n, 0, 8, 1, 1, 0x11, 0]))
    head += media._segment(0xC4, bytes([0]) + dc_body + bytes([16]) + ac_body)
    scan = lambda ss, se, ah, al, bits: media._scan_header((0,), ss, se, ah, al) + pack(bits)
    size = lambda v: abs(v).bit_length()
    low = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    out, previous = "", 0
    for b in coefficients:
        d, previous = (b[0] >> 1) - previous, b[0] >> 1
        out += code(dc_codes, size(d)) + low(d)
    streams = [scan(0, 0, 0, 1, out), scan(0, 0, 1, 0, "".join(str(b[0] & 1) for b in coefficients))]
    shift = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)
    out = ""
    for b in coefficients:
        run = 0
        for v in map(shift, b[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                out, run = out + code(ac_codes, 0xF0), run - 16
            out, run = out + code(ac_codes, 16 * run + size(v)) + low(v), 0
        out += code(ac_codes, 0) if run else ""
    streams.append(scan(1, 63, 0, 1, out))
    out = ""
    for b in coefficients:  # refinement: new ones of magnitude 1, a correction bit for each known one
        run, corrections, last = 0, "", max([k for k in range(1, 64) if abs(b[k]) == 1], default=0)
        for k in range(1, 64):
            if shift(b[k]):
                corrections += str(abs(b[k]) & 1)
            elif k > last:
                continue
            elif b[k] == 0:
                run += 1
                if run > 15 and last > k:
                    out, run, corrections = out + code(ac_codes, 0xF0) + corrections, 0, ""
            else:
                out, run, corrections = out + code(ac_codes, 16 * run + 1) + ("1" if b[k] > 0 else "0") + corrections, 0, ""
            if k == last:
                tail = "".join(str(abs(b[j]) & 1) for j in range(k + 1, 64) if shift(b[j]))
        if last < 63:
            out += code(ac_codes, 0) + (tail if last else corrections)
    return head + b"".join(streams) + scan(1, 63, 1, 0, out) + b"\xff\xd9"


def test_refined_coefficients():
    rng = np.random.default_rng(4)
    blocks = np.where(rng.random((6, 64)) < 0.15, rng.integers(-6, 7, (6, 64)), 0)
    (found,) = media.decode_coefficients([slow_progressive(blocks.tolist())])
    assert (found[1][0] == blocks).all()
    assert media.to_rgb(*found).shape == (48, 8, 3)


def test_inverse_transform():
    c = np.zeros((1, 64))
    c[0, 0] = 80
    plane = media._plane(c, {"high": 1, "wide": 1}, np.ones(64))
    assert (plane == 138).all()
    assert media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(media.ZIGZAG) == list(range(64))


BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            double = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
            good = [True, k != 1 or all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and double % 10 == 0, 10 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("12 .+-@ab(5)0.9_é\n") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute_spans(text)


def test_field():
    field = pii.trained()
    held = pii.training_windows(200, seed=77)
    assert sum(field.decode(t, 0, len(t)) == g for t, g in held) >= 0.9 * len(held)
    text = "cards 7536784127813050 4845168114407329 here"
    base, added = pii.find_spans(text, field)
    assert base == [] and [text[s:e] for s, _, e in added] == ["7536784127813050", "4845168114407329"]


def test_numbers_that_are_no_personal_data():
    """Numbers made here, not by the generator of the training windows."""
    field, rng = pii.trained(), random.Random(19)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def luhn(n):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(n[::-1])) % 10 == 0

    def ean():
        n = num(12)
        return n + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(n)) % 10)

    plain = [n for size in range(1, 25) for n in (num(size) for _ in range(40)) if not (14 <= size <= 19 and luhn(n))]
    plain += [make() for make in (ean, lambda: "1" + num(12), lambda: f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}:{num(2)}:{num(2)}.{num(3)}Z", lambda: f"{num(3)}.{num(12)}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}") for _ in range(40)]
    for n in plain:
        for text in (n, f"logged at {n} by host", f"id={n};", f"({n}), next"):
            base, added = pii.find_spans(text, field)
            assert not added, (text, added)
            assert base or pii.mask(text, field) == text
    for _ in range(100):
        cards = []
        while len(cards) < 3:
            n = num(16)
            cards += [n] if luhn(n) else []
        text = "cards " + " ".join(cards) + " here"
        base, added = pii.find_spans(text, field)
        assert [text[s:e] for s, _, e in sorted(base + added)] == cards


def test_field_decodes_the_best_segmentation():
    field = pii.trained()
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["+1 555 ", "4111111111111111", " ", "a@b.co", "1.2.3.4", ",", "12"]) for _ in range(4))
        borders, found = pii.candidates(text, 0, len(text))
        scored = [(i, j, k, sum(field.weights.get(f, 0.0) for f in pii.span_features(text, borders[i], borders[j], k))) for i, j, k in found]

        def best(at, touching):
            value = 0.0 if at == len(borders) - 1 else best(at + 1, False)
            return max([value] + [s + touching * field.weights["touch"] + best(j, True) for i, j, _, s in scored if i == at])

        names = {(borders[i], k, borders[j]): s for i, j, k, s in scored}
        got = field.decode(text, 0, len(text))
        total = sum(names[x] for x in got) + field.weights["touch"] * sum(a[2] == b[0] for a, b in zip(got, got[1:]))
        assert abs(total - best(0, False)) < 1e-9


def test_personal_data(spark, none):
    texts = [None, "", "mail a.b@c.org or 10.0.0.1", "+1 (555) 555-0100 é 4111 1111 1111 1111", "1.2.3.999"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in spans) for n in range(4)]
    assert pii.personal_data(none).count() == 0
    hidden = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert (hidden[0], hidden[1], hidden[2], hidden[3]) == (None, "", "mail <email> or <ip>", "<phone> é <card>")


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="<p>";</script></head><body class="has-sidebar"><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, very long text about cookies and why we need so many of them.</div>
<div id="content"><h1>The &amp; title</h1><p>First paragraph, long enough to be a text &copy; of its own.<p>Second   one with a <a href="/x">link</a>\n inside it.
<div class="ad">Buy now, buy more, buy often, and never stop buying it.</div><p>Third and last paragraph of this page.</p></div>
<div class="comments"><p>I liked this very much, said a reader in a comment that is longer than the page.</p></div><form><label>Name</label></form><footer>foot</footer></body></html>"""


def test_html_text(spark):
    want = "The & title\nFirst paragraph, long enough to be a text © of its own.\nSecond one with a link inside it.\nThird and last paragraph of this page."
    assert html_text.main_text(PAGE) == want
    assert [html_text.main_text(x) for x in (None, "", "plain", "<p>a<p>b", "<body>", "<div><b>x", "&am")] == ["", "", "plain", "a\nb", "", "x", "&am"]
    df = spark.createDataFrame([(1, "u", PAGE, "z"), (2, None, None, "z"), (1, "u", PAGE, "z")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(1, "u", want, len(want))] * 2 + [(2, "", "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_of_the_table(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert html_text.main_text(r.html) == "\n".join(x for x in blocks if x)


def test_an_article_inside_the_text_does_not_replace_it():
    paragraphs = [f"Paragraph {i} of the main text, long enough to weigh more than any card beside it." for i in range(4)]
    card = "<article><h2>Card</h2><p>A short teaser of another page.</p></article>"
    page = "<body><div>" + "".join(f"<p>{p}</p>" for p in paragraphs[:2]) + card + "".join(f"<p>{p}</p>" for p in paragraphs[2:]) + "</div></body>"
    assert html_text.main_text(page).split("\n") == [*paragraphs[:2], "Card", "A short teaser of another page.", *paragraphs[2:]]
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    beside = "A paragraph beside the article that is as dense as those within, so that the threshold takes it in too."
    got = html_text.main_text(f"<body><div><article>{inner}</article><p>{beside}</p></div></body>")
    assert got.split("\n") == [*paragraphs, beside]


def test_words_of_classes_do_not_take_the_text():
    body = "<h1>Title</h1><p>The first paragraph of the page, of some length.</p><p>The second paragraph of the page, of some length.</p>"
    want = ["Title", "The first paragraph of the page, of some length.", "The second paragraph of the page, of some length."]
    for page in (
        f'<div class="layout with-sidebar"><div id="content">{body}</div><div class="sidebar">side</div></div>',
        f'<div class="page no-ads">{body}</div>',
        f'<form id="aspnetForm"><nav>menu</nav><div>{body}</div></form>',
        f'<div class="notice">{body}</div>',
        f'<div><div>{body}</div><div class="discussion"><p>{"A reader says much more than the page does. " * 9}</p></div></div>',
        f'<div><div>{body}</div><ul class="comment-list"><li>{"A reader says much more than the page does. " * 9}</li></ul><div id="site-footer">foot</div></div>',
    ):
        assert html_text.main_text(f"<body>{page}</body>").split("\n") == want
    inside = '<article><h1>Title</h1><p class="share-price">The share price rose by nine percent.</p><p>Press <button>Save</button> or the <label>name</label> field.</p></article>'
    assert html_text.main_text(inside).split("\n") == ["Title", "The share price rose by nine percent.", "Press Save or the name field."]


def test_sections_of_an_article_stay_whatever_their_class():
    body = "<p>A paragraph of the article that is long enough to count for something, as they are.</p>"
    for odd in ('<section id="discussion"><h2>Discussion</h2><p>What it means.</p></section>', '<section id="copyright"><p>What it means.</p></section>', '<p class="notice">What it means.</p>', '<div class="menu"><p>What it means.</p></div>'):
        for around in ("<main>{}</main>", "<article>{}</article>", "<main><article>{}</article></main>"):
            text = html_text.main_text(f"<html><body>{around.format(body + odd + body)}</body></html>")
            assert "What it means." in text and text.count("A paragraph") == 2
    kept = html_text.main_text(f'<html><body><article>{body}<div class="comments"><p>I agree</p></div><div class="share">Tell others</div>{body}</article><div class="notice">We use</div></body></html>')
    assert kept.count("A paragraph") == 2 and "I agree" not in kept and "Tell" not in kept and "We use" not in kept


@pytest.mark.parametrize("wrap", ["<main>{}</main>", "<div>{}</div>", "{}"])
def test_comments_behind_an_article_are_known_by_their_structure(wrap):
    article = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {i} of an article that says a few things about its matter.</p>" for i in range(8)) + "</article>"
    said = [f"Reader {i} has a rather long opinion on all of this, and no words of a list around it." for i in range(30)]
    lists = [
        '<div class="talkback">' + "".join(f'<div class="entry"><b>u{i}</b><p>{t}</p></div>' for i, t in enumerate(said)) + "</div>",
        "<section><ol>" + "".join(f"<li><p>{t}</p></li>" for t in said) + "</ol></section>",
        '<div class="more"><ul>' + "".join(f'<li><a href="/{i}">Another story, number {i}</a></li>' for i in range(12)) + "</ul></div>",
    ]
    want = html_text.main_text(f"<html><body>{article}</body></html>")
    assert want.count("Paragraph") == 8
    for after in lists:
        assert html_text.main_text(f"<html><body>{wrap.format(article + after)}</body></html>") == want
    # a text that only begins with a card stays, and so do paragraphs behind the article
    card = "<article><a href='/x'>Card</a> short</article>"
    sections = "".join(f'<section class="part"><p>{t} {t}</p></section>' for t in said[:6])
    text = html_text.main_text(f"<html><body>{wrap.format(card + '<div>' + sections + '</div>')}</body></html>")
    assert all(t in text for t in said[:6])


def test_density_sums_against_brute_force():
    """Random trees: the subtree of the largest sum of densities, and what the threshold takes in."""
    import math
    from xml.etree import ElementTree

    rng = random.Random(21)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{'w' * rng.randint(1, 80)}{f'<a>{chr(108) * rng.randint(1, 30)}</a>' if rng.random() < 0.4 else ''}</p>"
        return "<div>" + "".join(grow(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    def measure(node):
        size, links = len("".join(node.itertext())), [a for a in node.iter("a") if a is not node]
        return size, sum(1 for _ in node.iter()) - 1, size if node.tag == "a" else sum(len("".join(a.itertext())) for a in links), len(links)

    for _ in range(300):
        page = "<body>" + "".join(grow(3) for _ in range(rng.randint(1, 4))) + "</body>"
        body = ElementTree.fromstring(page)
        total, _, total_links, _ = measure(body)

        def density(node):
            c, t, lc, lt = measure(node)
            base = math.log(c / max(1, c - lc) * lc + total_links / total * c + math.e)
            inner = c / max(1, lc) * t / max(1, lt)
            return 0.0 if not c or inner <= 1 else c / max(1, t) * (math.log(inner) / math.log(base) if base > 1 else math.log(inner))

        nodes = list(body.iter())
        parent = {child: node for node in nodes for child in node}
        sums = [sum(map(density, node)) for node in nodes]
        best = nodes[sums.index(max(sums))]
        path = [best]
        while path[-1] is not body:
            path.append(parent[path[-1]])
        least = min(map(density, path))
        roots = [best] + [x for node in path[1:] for x in node if x not in path and x.tag != "a" and density(x) >= least > 0]
        kept = {x for root in roots for x in root.iter()}
        want = ["".join(x.itertext()) for x in nodes if x.tag == "p" and x in kept]
        assert html_text.main_text(page).split("\n") == (want if any(want) else [""]), page


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>the text of a deep page</p>" + "</div>" * 3000
    assert html_text.main_text(f"<body>{deep}</body>") == "the text of a deep page"
    long = [f"paragraph {i} of a very long page with a number of words" for i in range(20_000)]
    assert html_text.main_text("<body><div>" + "".join(f"<p>{x}</p>" for x in long) + "</div></body>").split("\n") == long
    one = "word " * 400_000
    assert html_text.main_text(f"<body><p>{one}</p></body>") == one.strip()
    twin = "<div><p>one two three</p><p>one two three</p></div>"
    assert html_text.main_text(f"<body><section>{twin}</section><section>{twin}</section></body>").startswith("one two three\none two three")


def test_text_after_an_odd_declaration_stays():
    for odd in ("<![foo[x]]>", "<![>", "<![ 1>", "<![CDATA[x>", "<![if gt IE 8>", "<![CDATA[x]]>", "<![endif]>", "<!foo>", "<!>"):
        assert html_text.main_text(f"<p>a</p>{odd}<p>b</p>") == "a\nb"
    assert html_text.main_text("<p>a</p><![CDATA[x><p>b</p><script>//<![CDATA[\n//]]></script><p>c</p>") == "a\nb\nc"
    rng = random.Random(6)
    parts = ["<![", "[", "]", "]]>", "]>", ">", "<!", "--", "<", "/", "p", "?", "&", "#", ";", '"', "=", " ", "CDATA[", "if", "doctype", "é", "\n"]
    for _ in range(3000):
        page = "<p>a</p>" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert html_text.main_text(page).startswith("a")


def test_field_windows_cut_nothing():
    field = pii.trained()
    rng = random.Random(12)

    def unsplit(text):
        taken = pii.base_spans(text)
        return [x for x in field.decode(text, 0, len(text)) if all(x[2] <= s or e <= x[0] for s, _, e in taken)]

    cards = [pii._with_luhn(rng, 16, True) for _ in range(1000)]
    text = " ".join(c[i : i + 4] for c in cards for i in range(0, 16, 4))
    base, added = pii.find_spans(text, field)
    assert len(text) > 19_990 and base == [] and added == unsplit(text)
    assert len(list(pii.windows(text))) == 1
    assert list(pii.windows("4111 - 1111 - 1111 - 1111")) == [(0, 25)]
    parts = ["4111", " ", " - ", "+", "(", ")", "@", ".", "b.co", "\n", "#", "é", "²", "٣", "x" * 70, "a", " word ", "12", "1.2.3.4", "4111111111111111", ", of a longer sentence with words "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.find_spans(text, field)[1] == unsplit(text)
        borders, inside = set(pii.atom_borders(text, 0, len(text))), list(pii.windows(text))
        assert all(a in borders and b in borders for a, b in inside)
        every, found = pii.candidates(text, 0, len(text))
        assert all(any(a <= every[i] and every[j] <= b for a, b in inside) for i, j, _ in found)
