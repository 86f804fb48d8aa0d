"""Near duplicates, decontamination, language, licences, quality, and the pipeline."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tarnmark.llm import decontaminate, language, license_scan, near_dup, packing, pii, quality, queries
from tarnmark.llm.graph import connected_components
from tarnmark.llm.tokens import public_path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_says_what_its_sql_says(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(base)]
    for k in range(1, 14):
        x = list(base)
        for _ in range(k):
            x[rng.randrange(len(x))] = rng.choice(words)
        texts.append(" ".join(x))
    texts += [texts[0], texts[3].upper(), None, "", " \n ", "one two", "One  two", "one two three", " ".join(rng.choice(words) for _ in range(90))]
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(5)]
    rows = [(i, t, "rep", 1) for i, t in enumerate(texts)] + [(3, texts[3], "rep", 1), (None, texts[0], "rep", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, rep string, n int").repartition(3)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_all_pairs(docs, width):
    rows = [(r.doc_id, shingles(r.text, width)) for r in docs.collect()]
    group = {i: {i} for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    want = sorted((i if i is not None else -1, len(s), min(group[i]) if i is not None else -1) for i, s in rows)
    got = near_dup.near_duplicates(docs, width=width).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(docs, threshold=50)


def test_signatures_share_a_key_within_the_distance():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, near_dup.SLOTS)
        b = a.copy()
        b[rng.choice(near_dup.SLOTS, near_dup.FOUND_DISTANCE, replace=False)] += 1
        differ = (a != b).reshape(-1, near_dup.CHUNK).sum(axis=1)
        assert differ.min() <= 1


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 30, 200, 1024, 1500, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for share in (0.02, 0.1):
            b = np.unique(np.concatenate([a[int(share * n) :], rng.integers(0, 2**63, int(share * n), dtype=np.uint64)]))
            apart = len(np.setxor1d(a, b))
            x = near_dup.parity_sketch(a) ^ near_dup.parity_sketch(b)
            distance = sum(int(w).bit_count() for w in x.view("<u8"))
            level = near_dup.sketch_level(len(a))
            drawn = apart * 0.5**level
            assert near_dup.sketch_level(len(b)) != level or distance <= drawn + 5 * (drawn * (1 - 0.5**level)) ** 0.5
        assert len(a) / 2 ** near_dup.sketch_level(len(a)) <= near_dup.SKETCH_SHINGLES


def test_dense_group_of_near_copies(spark):
    """Every degree of edit around one text: many components within the same buckets."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(100)]
    rows = []
    for i in range(160):
        x = list(base) if i % 4 else list(rng.choice(rows)[1].split() if rows else base)
        for _ in range(rng.randrange(0, 14)):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((i, " ".join(x)))
    rows += [(7, "another text under an id that repeats " * 3), (900, "another text under an id that repeats " * 3)]
    sets = [(i, shingles(t, 4)) for i, t in rows]
    group = {k: {k} for k in range(len(sets))}
    for k, (_, a) in enumerate(sets):
        for m in range(k):
            b = sets[m][1]
            if 100 * len(a & b) >= 80 * len(a | b) and group[k] is not group[m]:
                group[k] |= group[m]
                for x in group[m]:
                    group[x] = group[k]
    want = sorted((i, min(sets[x][0] for x in group[k])) for k, (i, _) in enumerate(sets))
    assert len({c for _, c in want}) > 20
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 20), (None, 1)] + [(100, 100 + k) for k in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1} | {k: 4 for k in range(4, 10)} | {100 + k: 100 for k in range(40)}


def test_contamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "é", "the"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(n)) for k, n in enumerate([3, 5, 9, 10, 12, 15, 1, 4])] + [("copy", None), ("none", " .")]
    items.append(("same", items[3][1]))
    texts = [None, "", "?!", *(text(rng.randint(1, 60)) for _ in range(25)), f"x {items[5][1].upper()} y", f"{items[3][1]} {items[4][1]}"]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for name, item in items:
            words = split(item)
            k = min(10, len(words))
            for s in range(len(words) - k + 1 if k else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == words[s : s + k]:
                        hit |= set(range(at, at + k))
                        found.add(name)
        want[i] = (len(w), len(hit), len(found))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, words string, h int").repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(df, bench).collect()} == want
    odd = spark.createDataFrame([(1, texts[-1]), (1, texts[-1]), (1, "clean words"), (None, texts[-2]), (None, None)], "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.contamination(odd, bench).collect())
    n = len(texts)
    assert got == sorted([(1, *want[n - 1][:2])] * 2 + [(1, 2, 0), (0, *want[n - 2][:2]), (0, 0, 0)])
    long = spark.createDataFrame([(1, "zz " * 30_000 + items[5][1] + " yy" * 30_000)], "doc_id long, text string")
    assert decontaminate.contamination(long, bench).first().n_hit >= 15
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(df, bench).collect()} == want
    clean = decontaminate.contamination(df, bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op6_decontaminate", "op8_licenses"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_licences_against_brute_force(spark):
    def bigrams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return set(zip(w, w[1:]))

    t = license_scan.TEMPLATES
    texts = [None, "", "word", t["MIT"], "x\n" + t["MIT-line"] + "\ny z", t["Apache-2.0-line"].upper(), t["ISC"].replace(". ", ".\n"), "Licensed under CC BY 4.0", t["MIT"] + "\n" + t["Unlicense"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, round(r.dice, 9), r.n_units, r.licenses) for r in license_scan.license_scan(df, license_scan.template_table(spark)).collect()}
    for i, text in enumerate(texts):
        best, units, names = (0.0, None), set(), set()
        lines = (text or "").split("\n")
        for u, unit in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
            for name in sorted(t):
                a, b = bigrams(unit), bigrams(t[name])
                dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if dice >= 0.8:
                    units.add(u)
                    names.add(name)
                    best = max(best, (dice, name), key=lambda x: (x[0], [-ord(c) for c in x[1] or ""]))
        assert got[i] == (best[1], round(best[0], 9), len(units), ",".join(sorted(names)))


def test_licences_inside_longer_texts(spark):
    import textwrap

    t, full = license_scan.TEMPLATES, license_scan.COMPLETE
    code = "\n".join(f"value_{i} = compute_{i}(left, right)" for i in range(80))
    comment = lambda x: "\n".join("# " + line for line in textwrap.wrap(x, 70))
    texts = [
        comment(t["Apache-2.0-header"]) + "\n" + code,
        "MIT License\n\nCopyright (c) 2026 A Person\n\n" + textwrap.fill(full["MIT-text"], 78),
        code + "\n" + comment(full["ISC-text"]) + "\n" + code,
        textwrap.fill(full["BSD-2-Clause-text"], 78),
        code + "\n\n" + textwrap.fill(full["BSD-3-Clause-text"], 60) + "\n" + code,
        code + "\nThis file is part of a tool. " + t["GPL-3.0-line"] + " Ask us for more of it at any time.\n" + code,
        code + "\n" + (comment(t["GPL-3.0-header"]) + "\n") * 2 + code,
        code,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.license_id, r.dice, r.n_units) for r in license_scan.license_scan(df, license_scan.template_table(spark)).collect()), key=lambda r: r[0])
    want = ["Apache-2.0-header", "MIT-text", "ISC-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-3.0-line", "GPL-3.0-header", None]
    assert [r[1] for r in got] == want
    assert all(r[2] == (1.0 if r[1] else 0.0) for r in got)
    assert (got[5][3], got[6][3], got[7][3]) == (1, 2, 0)


def test_language(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language.learn(d)
    got = language.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "der die und ist nicht")], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "de"]
    assert language.learn(d.where("lang is null")) is None
    assert language.identify(odd, None).where("lang_pred <> 'und' or score <> 0").count() == 0


def slow_ngrams(text):
    """Counts of hashed n-grams, one letter at a time."""
    x = [32]
    for c in text.lower():
        if c.isalpha():
            x.append(ord(c))
        elif x[-1] != 32:
            x.append(32)
    x += [32] * (x[-1] != 32)
    out = [0] * language.BUCKETS
    for i, c in enumerate(x):
        one = c * 2654435761 % 2**32
        if c != 32:
            out[one >> 20] += 1
        if i + 1 < len(x):
            two = ((one ^ 0x9E3779B9) * 2246822519 + x[i + 1]) % 2**32 * 3266489917 % 2**32
            out[two >> 20] += 1
        if i + 2 < len(x):
            three = ((two ^ (two >> 15)) * 2246822519 + x[i + 2]) % 2**32 * 668265263 % 2**32
            out[three >> 20] += 1
    return out


def test_language_against_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(d, sample_rows=150)
    texts = [r.text for r in d.where("text is not null").limit(30).collect()] + ["Ein ÖLMÜHLE-Test, ja!", "x", "a b", "der die das " * 20_000]
    rows = [(i, t, "q", 0.5) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double").repartition(3)
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        x = [np.log(1 + n) * w for n, w in zip(slow_ngrams(texts[r.doc_id]), model.idf.tolist())]
        size = sum(v * v for v in x) ** 0.5
        cosines = [sum(v * c for v, c in zip(x, row)) / size for row in model.centroids.tolist()]
        assert abs(r.score - max(cosines)) < 1e-4
        assert r.lang_pred in {model.langs[j] for j, c in enumerate(cosines) if c > max(cosines) - 1e-5}
    assert language.identify(df.limit(0), model).count() == 0
    tied = language.NearestCentroid.__new__(language.NearestCentroid)
    tied.idf, tied.langs, tied.reach, tied.centroids = model.idf, ["a", "b"], [1.0, 1.0], np.vstack([model.centroids[:1]] * 2)
    assert {r.lang_pred for r in language.identify(df.limit(3), tied).collect()} == {"a"}


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i} ab" if i % 3 else "same text", "x" if i % 10 else "y") for i in range(5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    keep, language.NearestCentroid = language.NearestCentroid, lambda counts, langs, **k: seen.extend(langs)
    try:
        language.learn(d, sample_rows=400)
    finally:
        language.NearestCentroid = keep
    assert 60 < seen.count("x") <= 200 and 60 < seen.count("y") <= 200


def test_quality(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert quality.quality_scores(odd, labels.limit(0)).where("score <> 1").count() == 0
    good = quality.good_documents(d, labels)
    assert good.columns == d.columns and 0 < good.count() < d.count()


def test_discriminant_scores_are_gaussian_posteriors():
    rng = np.random.default_rng(3)
    d = quality.N_FEATURES
    seen = {c: (100.0 + c, rng.normal(size=d), (lambda a: a @ a.T + np.eye(d))(rng.normal(size=(d, d)))) for c in (0, 1)}
    model, x = quality.QuadraticDiscriminant(seen), rng.normal(size=(5, d))
    pooled = (seen[0][0] * seen[0][2] + seen[1][0] * seen[1][2]) / 201
    scale, log = np.sqrt(np.diag(pooled)) + 1e-6, []
    for c in (0, 1):
        s = 0.9 * seen[c][2] / np.outer(scale, scale) + 0.1 * pooled / np.outer(scale, scale)
        s = 0.95 * s + 0.05 * np.trace(s) / d * np.eye(d)
        z = x / scale - seen[c][1] / scale
        log.append(np.log(seen[c][0] / 201) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_pipeline_against_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id: r.text for r in d.collect()}
    good = {r.doc_id for r in quality.quality_scores(d, labels).where("predicted = 1").collect()}
    kept = {i: t for i, t in kept.items() if i in good}
    sets, group = {i: shingles(t, 5) for i, t in kept.items()}, {i: i for i in kept}
    changed = True
    links = [(i, j) for i in kept for j in kept if i < j and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            changed |= group[i] != group[j]
            group[i] = group[j] = low
    kept = {i: t for i, t in kept.items() if group[i] == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[s : s + k]) in windows for k in sizes for s in range(len(w) - k + 1))
    kept = {i: pii.mask(t, pii.trained()) for i, t in kept.items() if not hit(words(t))}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == sizes[r.doc_id]
    assert got == sizes


def test_statistics_and_moments_against_plain_sums(spark):
    rng = random.Random(8)
    texts = [None, "", "A b, c!\nA b\n\n9 | é", *("".join(rng.choice("ab Z9.,|é\n$") for _ in range(rng.randint(1, 300))) for _ in range(40)), "word " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: np.array(r.x) for r in quality.features(df).collect()}
    logit = lambda p: np.log((p + 0.002) / (1.002 - p))
    classes = [str.islower, str.isupper, str.isdigit, lambda c: c in " \t\n\r\f\v", lambda c: c in ".,;:?'\"()-", lambda c: c in "#$%&*@^~+=_`\\/<>{}[]", lambda c: c in "|!"]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        shares = [sum(1 for b in raw if b < 128 and f(chr(b))) for f in classes] + [sum(1 for b in raw if b > 127)]
        usual = [0.77, 0.02, 0.005, 0.16, 0.02, 0.005, 0.005, 0.015]
        want = [logit((n + 40 * u) / (len(raw) + 40)) for n, u in zip(shares, usual)]
        w, lines = raw.split(), raw.split(b"\n")
        want += [np.log(1 + len(w)), np.log((len(raw) - len(w) + 200) / (len(w) + 40)), logit((len(set(w)) + 40) / (len(w) + 40)), logit((len(set(lines)) + 5) / (len(lines) + 5)), np.log((len(w) + 40) / (len(lines) + 2))]
        assert np.allclose(got[i], want), i
    labels = spark.createDataFrame([(i, i % 2) for i in got], "doc_id long, label int")
    seen = quality.moments(labels.join(quality.features(df), "doc_id").select("label", "x"))
    for label in (0, 1):
        x = np.array([got[i] for i in sorted(got) if i % 2 == label])
        n, mean, cov = seen[label]
        assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-8)


def test_stages_keep_the_columns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs in (d.limit(0), d.where("doc_id < 3").withColumn("text", packing.F.lit(None).cast("string"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == d.columns, name


def test_stages_bear_any_columns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = {c: packing.F.lit(k) for k, c in enumerate(("gone_id", "row_number", "row_gone", "component_id", "hit_id", "words", "cls", "id", "set_hash"))}
    for docs in (d.withColumns(more), d.withColumns(more).union(d.withColumns(more).withColumn("doc_id", packing.F.lit(None).cast("long")))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf_dir)
            assert got.columns == docs.columns and got.count() <= docs.count(), name


def test_timestamps_survive_the_mask(spark, sf_dir):
    text = "logged at 1700000000123 by 4006381333931, card 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert corpus_pipeline.mask_personal_data(spark, df, sf_dir).first().text == text.replace("4111 1111 1111 1111", "<card>")


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    near = a + " end"
    rows = [(5, a, "x"), (5, a, "x"), (None, a, "x"), (2, near, "x"), (None, b, "y"), (None, b, "y"), (7, c, "z"), (7, d, "z"), (9, c, "z"), (8, d, "z"), (1, None, "n")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(3)
    got = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert got.schema == df.schema
    assert {tuple(r) for r in got.collect()} == {(2, near, "x"), (None, b, "y"), (7, c, "z"), (7, d, "z"), (1, None, "n")} and got.count() == 5
