"""SimHash groups and edit fingerprints against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from riskgrid.llm import editprint, simhash
from riskgrid.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def plain_groups(prints: dict, linked):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(prints, 2):
        if linked(prints[a], prints[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_golay_code_is_perfect():
    assert len(set(simhash.ERRORS.tolist())) == 2048
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    names = simhash.codeword(words)
    # All words within three bits of a codeword have its index.
    for name, word in zip(names, words):
        error = simhash.ERRORS[simhash._syndrome(np.array([word]))][0]
        assert bin(int(error)).count("1") <= 3
        nearest = word ^ error
        flips = [nearest ^ sum(1 << b for b in rng.choice(23, k, replace=False)) for k in range(4)]
        assert set(simhash.codeword(np.array(flips)).tolist()) == {int(name)}


def test_keys_meet_at_three_bits():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 4)), replace=False))
        asked = simhash.near_keys(np.array([a], np.uint64))[0]
        stored = simhash.own_keys(np.array([b], np.uint64))[0]
        assert set(asked.tolist()) & set(stored.tolist())


def test_groups_as_brute_force(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = simhash.near_duplicates(documents).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == {d: (prints[d], want[d]) for d in texts}


def test_long_chain_is_one_component(spark):
    n = 300
    nodes = spark.range(n).select(F.col("id").alias("node"))
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(nodes, links, "chain").collect()} == {0}


def test_awkward_rows(awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["component_id"] == 0 and by_id[7]["component_id"] == 6 and by_id[9]["component_id"] == 9
    # No words: fingerprint zero, linked like any other; the fewest words: all of them.
    assert by_id[2]["fp"] == by_id[3]["fp"] == by_id[4]["fp"] == 0 and by_id[4]["component_id"] == 2
    assert by_id[10]["fp"] % (1 << 64) == xxhash.xxh64_intdigest(b"a a", 42)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 2, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    assert simhash.keep_one(nothing).count() == 0


def edit_distance_walk(text):
    """The walk, step by step."""
    codes, table = editprint.classes(text), editprint.dwell()
    step, found = 0, []
    for c in codes:
        found.append(step)
        step += table[c, step % editprint.PERIOD]
    return [*found, step]


def test_walks_side_by_side(documents):
    texts = [r["text"] for r in documents.limit(60).collect()] + ["", "a", "ab" * 7000]
    walks = editprint.walk([editprint.classes(t) for t in texts], [0] * len(texts))
    for text, steps in zip(texts, walks):
        assert steps.tolist() == edit_distance_walk(text)


def test_edit_study_as_brute_force(documents):
    rows = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    prints = {d: editprint._prints([t])[2][0] for d, t in rows}
    got = {r["doc_id"]: r for r in editprint.edit_study(documents, range_bytes=1 << 15).collect()}
    assert len(got) == len(rows)
    for k, (d, text) in enumerate(rows):
        after, following = rows[(k + 1) % len(rows)]
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == prints[d] and r["edited_fingerprint"] == editprint._prints([edited])[2][0]
        assert r["near_edited"] == editprint.likeness(prints[d], r["edited_fingerprint"])
        assert r["near_next"] == editprint.likeness(prints[d], prints[after])
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in got.values()])


def test_small_edits_stay_near():
    text = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    base = editprint._prints([text])[2][0]
    insert = text[:900] + "xyz" + text[900:]
    delete = text[:1500] + text[1502:]
    other = " ".join(f"item{k * 104729 % 1000}" for k in range(400))
    near = [editprint.likeness(base, editprint._prints([t])[2][0]) for t in (insert, delete, other)]
    assert min(near[:2]) > 0.6 > near[2] + 0.2


def test_edit_study_awkward(awkward, nothing, spark):
    got = editprint.edit_study(awkward, range_bytes=1 << 12).collect()
    assert len(got) == awkward.count()
    assert {(r["n_chars"], r["fingerprint"]) for r in got if r["doc_id"] in (2, 3)} == {(0, editprint._prints([""])[2][0])}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (0, 1)}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert editprint.edit_study(nothing).count() == 0
    alone = editprint.edit_study(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0


def test_near_groups(spark):
    base = [" ".join(f"w{(k * 7919 + s * 131) % 997}" for k in range(300)) for s in range(5)]
    rows = [(s, t) for s, t in enumerate(base)] + [(10 + s, t + " tail") for s, t in enumerate(base)] + [(20, base[0]), (30, None), (31, "")]
    prints = editprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in editprint.near_groups(prints).collect()}
    assert got == {**{s: s for s in range(5)}, **{10 + s: s for s in range(5)}, 20: 0, 30: 30, 31: 30}


def planted(n_words, similarity, seed):
    """A text and a copy with words replaced at even places, until five-word shingles are so similar or just above."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    copy, own = list(words), shingles(words)
    for at in rng.sample(range(n_words), n_words):
        changed = copy[:at] + [f"x{rng.randrange(10**6)}"] + copy[at + 1 :]
        other = shingles(changed)
        if len(own & other) >= similarity * len(own | other):
            copy = changed
    return " ".join(words), " ".join(copy)


def test_stage_finds_planted_copies(spark):
    kinds = [(n, s, k) for n in (60, 100, 300) for s in (0.8, 0.85, 0.9, 0.95) for k in range(5)]
    rows = [t for i, kind in enumerate(kinds) for t in zip((2 * i, 2 * i + 1), planted(*kind[:2], i))]
    # Half alike: not near copies.
    apart = [t for i in range(20) for t in zip((1000 + 2 * i, 1001 + 2 * i), planted(200, 0.6, 500 + i))]
    kept = simhash.keep_one(spark.createDataFrame(rows + apart, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] < 1000) == [2 * i for i in range(len(kinds))]
    assert len([r for r in kept if r["doc_id"] >= 1000]) == len(apart)


def test_stage_as_brute_force(documents):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {r["doc_id"]: shingles(r["text"]) for r in documents.collect()}
    want = plain_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents).collect()) == sorted(set(want.values()))


def test_stage_keeps_a_row_of_each_group_whatever_the_ids(spark):
    texts = [" ".join(f"w{k}_{n}" for n in range(40)) for k in range(6)]
    near = [t + " more" for t in texts]
    rows = [(None, texts[0]), (None, texts[1]), (None, near[1]), (7, texts[2]), (7, texts[3]), (7, near[3])]
    # One id in two groups, the smaller one in the first alone; the null id comes last; the same row twice.
    rows += [(1, texts[4]), (7, near[4]), (None, texts[5]), (9, near[5]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {t: k for k in range(6) for t in (texts[k], near[k])}
    kept = [sorted(map(tuple, simhash.keep_one(d).collect()), key=str) for d in (docs, docs.repartition(5), docs.orderBy(F.desc("text")))]
    assert kept[0] == kept[1] == kept[2]
    assert sorted((groups[t], d) for d, t in kept[0] if d is not None) == [(2, 7), (3, 7), (4, 1), (5, 9)]
    assert sorted(groups[t] for d, t in kept[0] if d is None) == [0, 1]


def jaccard_groups(texts):
    """Components of texts with 0.8 of their five-word shingles in common, every pair looked at."""
    sets = {}
    for d, t in texts.items():
        words = (t or "").lower().split()
        sets[d] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    return plain_groups(sets, lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b))


def groups_found(spark, texts, **parameters):
    docs, groups = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), {}
    for r in simhash.near_copies(docs, **parameters).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    return {d: min(g) for g in groups.values() for d in g}


def test_no_link_is_lost_in_a_crowd(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    body = [word() for _ in range(400)]
    # Pages of one boilerplate, 0.79 alike, each with a tail of its own; 60 have a partner that shares part of its tail.
    tails = [[word() for _ in range(52)] for _ in range(700)]
    texts = {n: " ".join(body + t) for n, t in enumerate(tails)}
    for n in range(60):
        texts[10_000 + n] = " ".join(body + tails[n][:14] + [word() for _ in range(38)])
    got = groups_found(spark, texts)
    assert got == jaccard_groups(texts)
    assert sum(got[10_000 + n] == n for n in range(60)) == 60


def test_crowds_of_variants_as_brute_force(spark):
    rng = random.Random(6)
    texts = {}
    for body in ([f"a{k}" for k in range(120)], [f"b{k}" for k in range(60)]):
        for _ in range(110):
            words = list(body)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
                words[rng.choice((7, 31, 44, rng.randrange(len(words)))) % len(words)] = f"x{rng.randrange(40)}"
            words += [f"t{rng.randrange(10**6)}" for _ in range(rng.choice((0, 0, 5, 15, 25, 30)))]
            texts[len(texts)] = " ".join(words)
    want = jaccard_groups(texts)
    assert 20 < len(set(want.values())) < 200
    # Few or many common shingles: the work moves between the two ways, the groups stay.
    for common in (4, 1000):
        assert groups_found(spark, texts, common=common) == want


def variants(n, seed):
    """Texts of one boilerplate with up to 3 words changed, at places where many others have been changed as well."""
    rng = random.Random(seed)
    for _ in range(n):
        words = [f"a{k}" for k in range(146)]
        for _ in range(rng.randrange(4)):
            words[rng.choice((7, 20, 31, 44, 58, 70, 83, 95, 110, 121, 133))] = f"x{rng.randrange(3)}"
        yield " ".join(words)


def test_classes_of_a_crowd_meet_its_hub_not_each_other(spark):
    sets = {n: set(simhash.shingle_hashes(t, 5).view("int64").tolist()) for n, t in enumerate(sorted(set(variants(400, 8))))}
    link = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    held = [(n, len(s), sorted(s)) for n, s in sets.items()]
    ordered = spark.createDataFrame([(n, s, [], h) for n, s, h in held], "node long, s int, first array<long>, shared array<long>")
    open_ = spark.createDataFrame([(1, n, n) for n in sets], "key long, node long, root long")
    asked = {tuple(r) for r in simhash._by_common(ordered, open_).collect()}
    nodes = {n: n for n in sets}
    assert plain_groups(nodes, lambda a, b: (a, b) in asked and link(a, b)) == plain_groups(nodes, link)
    keyed = spark.createDataFrame([(1, n, n, n, s, s, s) for n, s, _ in held], "key long, class long, low long, high long, s int, most int, sh int")
    tops = spark.createDataFrame([(n, s, n, h) for n, s, h in held], "class long, s int, rep long, shared array<long>")
    to_hub, beside = simhash._beside_hubs(keyed, tops)
    assert to_hub.count() == len(sets) - 1
    # All that are apart met each other before: some n * n / 2 pairs.
    assert len(sets) > 200 and simhash._class_pairs(beside).count() < 5 * len(sets)
