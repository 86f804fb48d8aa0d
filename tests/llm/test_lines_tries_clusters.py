"""Line dedup, the conversation trie and centroid clustering against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarnmark.llm import centroids, conversation_trie, line_dedup


# ------------------------------------------------------------------- lines


def brute_lines(rows, least=20, documents=3):
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text)."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    number = lambda i: -(1 << 63) if i is None else i
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(number(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < documents or number(i) == max(held[key(x)])]
        out.append((number(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(11)
    common = [f"Line number {k} that many documents hold" for k in range(12)] + ["short one", "é" * 19, "é" * 20, " " + "wide white space stays " + " "]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) for _ in range(rng.randrange(6))] + [f"own line of {i} in full length"] * rng.randrange(3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(("  " + x.upper() + "\t" if rng.random() < 0.3 else x) for x in lines)))
    rows += [(3, rows[3][1]), (7, "\n".join(common)), (None, "\n".join(common)), (None, common[0]), (61, None), (62, ""), (63, "\n\n"), (-5, common[2] * 3000 + "\n" + common[2])]
    return rows


def test_lines_against_brute_force(spark, line_rows):
    docs = spark.createDataFrame([(*r, "x", 1, b"k") for r in line_rows], "doc_id long, text string, last string, n int, key binary").repartition(5)
    for batches in (1, 4, 7):
        got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.deduplicated(docs, batches=batches).collect())
        assert got == brute_lines(line_rows)
    assert sum(r[2] for r in brute_lines(line_rows)) > 50
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.deduplicated(docs, batches=0)


def test_other_bounds_of_lines(spark, line_rows):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string")
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.deduplicated(docs, least_chars=5, least_documents=2).collect())
    assert got == brute_lines(line_rows, 5, 2)


@pytest.mark.parametrize("order", ["falling", "rising", "mixed"])
def test_runs_give_the_same_totals_in_any_order(spark, line_rows, order):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string")
    numbers = sorted({-(1 << 63) if i is None else i for i, _ in line_rows}, reverse=order == "falling")
    if order == "mixed":
        random.Random(2).shuffle(numbers)
    keys, runs = line_dedup.line_keys(docs).cache(), line_dedup.LineRuns(spark, buckets=3)
    for k in range(0, len(numbers), 14):
        runs.add(keys.where(keys.doc.isin(numbers[k : k + 14])))
        assert all(len(level) < 2 for level in runs.levels)
    held = defaultdict(set)
    for r in keys.collect():
        held[bytes(r.key)].add(r.doc)
    assert {bytes(r.key): r["last"] for r in runs.frequent().collect()} == {k: max(v) for k, v in held.items() if len(v) >= 3}
    runs.close()


def test_settled_keys_get_no_further_row(spark):
    keys = lambda docs: spark.createDataFrame([(d, b"k" * 16) for d in docs], "doc long, key binary")
    runs = line_dedup.LineRuns(spark, buckets=2)
    runs.add(keys([9, 8, 7]))
    runs.levels.append([])  # keeps the run from being compacted at once
    runs.levels = [[], *[runs.levels[0]]]
    runs.add(keys([3, 2]))
    assert spark.table(runs.levels[0][0]).count() == 0
    runs.add(keys([12]))
    assert [tuple(r)[1] for r in runs.frequent().collect()] == [12]
    runs.close()


# ------------------------------------------------------------ conversations


def brute_trie(rows):
    """Nodes as (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, digest) of rows (conv_id, turn, role, text)."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = defaultdict(int), []
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    said = ["hello there", "tell  me\tmore", "", None, "no break", "one two three four", "x " * 400]
    rows = []
    for c in list(range(0, 130)) + [-3, -20, 400, 411, 419]:
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), said[0] if t == 0 and rng.random() < 0.7 else rng.choice(said)))
    for c in range(200, 260):  # copies
        rows += [(c, 0, "user", "hello there"), (c, 1, "assistant", "same"), (c, 2, "user", "same again")]
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(300)]  # a long one
    rows += [(301, 5, "b", "tie"), (301, 5, "a", "tie"), (301, 5, "a", "other"), (301, 5, "a", "tie"), (301, 5, "a", "tie"), (None, 0, "user", "hello there")]
    return rows


@pytest.mark.parametrize("light", [1, 4, 32, 1000])
def test_trie_against_brute_force(spark, talks, light):
    df = spark.createDataFrame([(*r, "x", 7) for r in talks], "conv_id long, turn long, role string, text string, hi string, depth int").repartition(6)
    own = conversation_trie.sequences(df).cache()
    nodes = conversation_trie.trie_nodes(conversation_trie.rebuilt(own), light=light).collect()
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes)
    assert got == brute_trie(talks)


def test_trie_of_no_conversations(spark):
    none = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for rows in (none, none.limit(0)):
        assert conversation_trie.trie_nodes(conversation_trie.rebuilt(conversation_trie.sequences(rows))).count() == 0


def test_lots_hold_whole_shards(spark, talks, monkeypatch):
    """Many small lots give what one gives."""
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    rows = conversation_trie.prefixes(conversation_trie.rebuilt(conversation_trie.sequences(df).cache())).cache()
    below = conversation_trie.sharded(rows, conversation_trie._heavy(rows, 4))[0].toArrow()
    whole = list(conversation_trie._whole_shards(iter(below.to_batches())))
    assert len(whole) == 1
    monkeypatch.setattr(conversation_trie, "TRIE_ROWS", 10)
    lots = list(conversation_trie._whole_shards(iter(below.to_batches(max_chunksize=7))))
    assert len(lots) > 5 and sum(len(x["hi"]) for x in lots) == below.num_rows
    shards = [set(zip(x["s_hi"].tolist(), x["s_lo"].tolist())) for x in lots]
    assert sum(map(len, shards)) == len(set().union(*shards))


def test_louds_bits_tell_parents_and_children():
    rng = np.random.default_rng(4)
    conv, level, hi = [], [], []
    for c in range(200):
        path = 0
        for d in range(rng.integers(1, 7)):
            path = path * 3 + int(rng.integers(0, 3)) + 1
            conv.append(c), level.append(d), hi.append(path)
    conv, level, hi = (np.array(x) for x in (conv, level, hi))
    trie, node = conversation_trie._grown(conv, level, hi, hi * 5)
    again = conversation_trie.Louds(np.unpackbits(np.frombuffer(trie.packed()[0], np.uint8), count=len(trie.bits)), trie.labels, trie.levels)
    known = {(0, 0): 0} | {(int(d) + 1, int(h)): int(n) for d, h, n in zip(level, hi, node)}
    assert len(known) == len(trie.parent) == trie.bits.sum() + 1
    for (d, h), n in known.items():
        if d:
            above = known[d - 1, (h - 1) // 3 if d > 1 else 0]
            assert trie.parent[n] == again.parent[n] == above
            assert again.child(above, (h, h * 5)) == n
            assert again.child(above, (h, h * 5 + 1)) is None
    own = np.ones(len(trie.parent), np.int64)
    sums = trie.rolled_up(own)
    assert sums[0] == len(own)
    assert all(sums[n] == 1 + sum(sums[k] for k in np.flatnonzero(trie.parent == n)) for n in range(len(own)))


def test_succinct_tries_hold_the_prefixes(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    turns = conversation_trie.sequences(df).cache()
    made = conversation_trie.succinct(turns, light=10**6).collect()
    assert len(made) == 1
    labels = np.frombuffer(made[0].labels, "<i8").reshape(-1, 2)
    trie = conversation_trie.Louds(np.unpackbits(np.frombuffer(made[0].louds, np.uint8), count=2 * len(labels) - 1), labels, made[0].levels)
    at = {}
    for r in conversation_trie.prefixes(turns).orderBy("conv_id", "depth").collect():
        at[r.conv_id] = trie.child(at.get(r.conv_id, 0), (r.hi, r.lo))
        assert at[r.conv_id] is not None
    distinct = {tuple(x) for x in conversation_trie.prefixes(turns).select("depth", "hi", "lo").distinct().collect()}
    assert len(labels) == len(distinct) + 1


# ----------------------------------------------------------------- clusters


def brute_clusters(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of rows (vec_id, embedding)."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [v for _, v in named[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(cents)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = defaultdict(int)
    for _, j, d in found:
        total[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((-1 if i is None else i, j, d, total[j], sum(total.values()), digest[j]) for i, j, d in found)


def clustered(df, **settings):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters_with_inertia(df, **settings).collect())


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(0, 1, (9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(40)]  # a vector that many rows repeat
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (600, [0.0] * 64), (601, [2.0**18] * 64), (602, [-0.015625] * 64), (603, [-1e-9] * 64)]
    bad = [(700, None), (701, []), (702, [1.0] * 63), (703, [1.0] * 65), (704, [1.0] * 63 + [None]), (705, [float("nan")] + [1.0] * 63), (706, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<float>, cluster int, v string").repartition(5)
    assert clustered(df) == brute_clusters(rows + bad)
    assert clustered(df, k=3, rounds=0) == brute_clusters(rows, 3, 0)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert clustered(few) == brute_clusters(rows[:5])
    assert centroids.clusters_with_inertia(df.limit(0)).count() == 0
    beyond = spark.createDataFrame([(1, [3.0] * 64), (2, [2.0**22] * 64)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in centroids.clusters_with_inertia(beyond).collect()] == [1]
    with pytest.raises(ValueError):
        centroids.cluster(df, k=0)


def test_equally_near_centroids(spark):
    """Exact ties go to the smaller number."""
    rows = [(i, [float(i % 4)] * 64) for i in range(40)] + [(100 + i, [0.5 + i % 3] * 64) for i in range(30)]
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute_clusters(rows)


def test_screening_is_safe_and_saves_distances():
    rng = np.random.default_rng(5)
    for scale in (1, 64, 1 << 20):
        c = rng.integers(-scale, scale + 1, (16, 64)) * np.repeat(rng.integers(0, 4, (16, 8)), 8, axis=1)
        v = c[rng.integers(0, 16, 2000)] + rng.integers(-scale // 4 - 1, scale // 4 + 2, (2000, 64))
        screen = centroids.Screen(c)
        full = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (centroids.lower_bounds(*centroids.summaries(v), *centroids.summaries(c)) <= full).all()
        chosen, distance = screen.nearest(v, *centroids.summaries(v))
        assert (chosen == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        assert screen.exact < 0.5 * full.size
