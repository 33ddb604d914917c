"""Mixing, shards, licenses, quality, language and search: brute force, small cases, held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import langid, licenses, mixing, quality, search, sharding

# ------------------------------------------------------------------ mixing


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """(doc_id, source, text) -> per row: size, source size, target, taken."""
    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] >= most * sizes[s]}
        if not over:
            break
        full |= over
    copies, place = [], {}
    for s in names:
        own = sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (hashlib.md5(f"mix:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), rows[k][0] or 0, rows[k][2]))
        sent = 0
        for k in own:
            sent += rows[k][2]
            place[k] = sent
        copies += [((place[k] + e * sizes[s]) / target[s], s is None, s or "", place[k], e, k) for k in own for e in range(most) if rows[k][2]]
    taken, used = Counter(), 0
    for *_, k in sorted(copies):
        used += rows[k][2]
        if used > total:
            break
        taken[k] += rows[k][2]
    return sorted((str(d), n, sizes[s], round(target[s], 6), taken[k]) for k, (d, s, n) in enumerate(rows))


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_mix_as_brute_force(table, request, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)
    docs = request.getfixturevalue(table)
    want = plain_mix([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()])
    got = mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    drawn = Counter(str(r["doc_id"]) for r in mixing.draw(docs).collect())
    by_id = defaultdict(int)
    for r in got:
        by_id[str(r["doc_id"])] += r["epochs"]
    assert drawn == Counter({d: n for d, n in by_id.items() if n})


def test_targets_stop_and_share(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1000), (None, 10)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (1, 2, 3), 3).collect()}
    assert got["b"] == 3 and got[None] == 30 and got["a"] == pytest.approx((1111 - 33) / 4) and got["c"] == pytest.approx(3 * (1111 - 33) / 4)


def test_mix_of_nothing(spark, nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.draw(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(empty).collect()] == [(0, 0.0)] * 2


# ------------------------------------------------------------------ shards


def check_shards(docs, **how):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.place(docs, **how).collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, load


def test_shards_are_even(documents):
    got, load = check_shards(documents)
    most, mean = max(r["size"] for r in got), sum(load.values()) / 24
    assert set(load) <= set(range(24)) and max(abs(n - mean) for n in load.values()) <= most + mean / 16


def test_shards_hold_however_they_are_cut(documents):
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in check_shards(documents)[0]}
    for how in ({"rows_per_range": 3}, {"ranges_per_shard": 1, "rows_per_range": 5, "seed": 3}):
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in check_shards(documents, **how)[0]} == one


def test_hot_text_is_cut_and_small_groups_stay(spark):
    rows = [(k, "hot copy " * 20) for k in range(4000)] + [(10_000 + k, f"text {k // 2} " * 25) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, load = check_shards(docs, rows_per_range=300)
    assert max(load.values()) < 1.1 * sum(load.values()) / 24
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    assert sorted(len(s) for s in groups.values())[:-1] == [1] * 4000


def test_awkward_shards(awkward, nothing):
    check_shards(awkward)
    assert sharding.place(nothing).count() == 0


# ------------------------------------------------------------------ licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = sorted((i, i + len(p.split()) - 1, lab) for p, lab in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = []
    for r in licenses.rules():
        for i, w in enumerate(words):
            if w != r["keyword"]:
                continue
            c = licenses.CONTEXT
            window = " ".join([*words[max(0, i - c) : i], f"<{w}>", *words[i + 1 : i + 1 + c]])
            m = re.search(r["pattern"].replace("(?<=^| )", "(?:(?<= )|^)").replace("(?=$| )", "(?= |$)"), window)
            if m:
                start = i - m[0][: m[0].index("<")].count(" ")
                found.append((start, start + m[0].count(" "), r["label"], r["priority"], r["id"]))
    left = [
        d for d in found
        if not any(
            e[0] <= d[0] and e[1] >= d[1] and (e[3], e[1] - e[0], -e[4]) > (d[3], d[1] - d[0], -d[4]) for e in found
        )
    ]
    return len(words), base, sorted(left)


def test_scan_as_brute_force(spark, awkward, documents):
    made = spark.createDataFrame(
        [
            (100, "MIT License. This is under the MIT license, Apache license, Version 2.0, GNU Lesser General Public License v2.1 or later"),
            (101, "SPDX-License-Identifier: CC-BY-NC 4.0; all rights reserved"),
            (102, "mit license mit license " * 40),
            (103, "released under the terms of the GNU General Public License, version 3 or (at your option) any later version"),
            (104, "BSD 3-Clause License, WTFPL and the Unlicense; the mitlicense; éapache license"),
        ],
        "doc_id long, text string",
    )
    for docs in (made, awkward, documents):
        want = sorted((str(r["doc_id"]), *plain_scan(r["text"])) for r in docs.collect())
        got = [
            (
                str(r["doc_id"]), r["n_words"], sorted((b["start"], b["end"], b["label"]) for b in r["base"]),
                sorted((d["start"], d["end"], d["label"], d["priority"], d["id"]) for d in r["detections"]),
            )
            for r in licenses.scan(docs).collect()
        ]
        assert sorted(got) == want


def test_rules():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r["id"] for r in rules}) == len(rules)
    assert all(re.compile(r["pattern"].replace("(?<=^| )", "")) for r in rules)


def test_rules_find_their_texts(spark):
    rules = [r for r in licenses.rules() if r["sample"]]
    assert {r["form"] for r in rules} == {"notice", "identifier", "body"}
    texts = [(r["id"], r["sample"]) for r in rules]
    more = {
        9000: ("SPDX-License-Identifier: MIT", {"mit"}),
        9001: ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        9002: ("Licensed under MIT", {"mit"}),
        9003: ("it comes under the GPL", {"gpl"}),
        9004: ("a course under MIT teachers, an apache tribe, a vim of her own", set()),
    }
    docs = spark.createDataFrame(texts + [(k, v[0]) for k, v in more.items()], "doc_id long, text string")
    got = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in licenses.scan(docs).collect()}
    assert not [(r["sample"], r["label"], got[r["id"]]) for r in rules if r["label"] not in got[r["id"]]]
    assert {k: got[k] for k in more} == {k: v[1] for k, v in more.items()}


def test_scan_of_nothing(nothing):
    assert licenses.scan(nothing).count() == 0


def test_scan_stays_in_the_jvm(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ------------------------------------------------------------------ language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_as_brute_force(awkward):
    rows = awkward.collect()
    counts, texts = defaultdict(Counter), Counter()
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 != 1:
            texts[r["lang"]] += 1
            for part in langid.buckets(r["text"] or ""):
                counts[r["lang"]].update(part.tolist())
    names, size, a = sorted(texts), 1 << langid.BITS, langid.SMOOTH

    def best(text):
        grams = [b for part in langid.buckets(text or "") for b in part.tolist()]
        if not grams:
            return "und"
        score = {
            lang: math.log((texts[lang] + a) / (sum(texts.values()) + a * len(names)))
            + sum(math.log((counts[lang][b] + a) / (sum(counts[lang].values()) + a * size)) for b in grams)
            for lang in names
        }
        return max(names, key=lambda lang: score[lang])

    got = langid.identify(awkward).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted((str(r["doc_id"]), best(r["text"])) for r in rows)


def test_language_pieces_and_edges(awkward, nothing, monkeypatch):
    text = "Ab, cd 12 éf " * 50
    whole = np.sort(np.concatenate(list(langid.buckets(text))))
    monkeypatch.setattr(langid, "PIECE", 17)
    assert np.array_equal(np.sort(np.concatenate(list(langid.buckets(text)))), whole)
    assert langid.identify(nothing).count() == 0 and langid.keep_known(nothing).count() == 0
    unlabelled = langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    kept = langid.keep_known(awkward)
    assert kept.columns == awkward.columns
    assert not {2, 3, 4, 13} & {r["doc_id"] for r in kept.collect()} and {0, 1, 8} <= {r["doc_id"] for r in kept.collect()}


# ------------------------------------------------------------------ quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    got = quality.assess(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").collect()
    assert np.mean([r["keep"] for r in got if r["quality"] == 1]) > 0.98
    assert np.mean([r["keep"] for r in got if r["quality"] == 0]) < 0.2


def test_co_training_hands_labels_over():
    """Few labels, views that are each enough: the pool makes both better than the labels alone."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000).astype(float)
    views = tuple((y[:, None] * 2 - 1) * 0.45 + rng.normal(size=(2000, 12)) for _ in range(2))
    known, pool = tuple(v[:60] for v in views), quality.HeldPool(tuple(v[60:] for v in views))

    def right(model):
        return np.mean((model.text.raw(views[0]) + model.page.raw(views[1]) > 0) == (y > 0.5))

    alone, together = quality.co_train(known, y[:60], 0.5, pool, rounds=0), quality.co_train(known, y[:60], 0.5, pool)
    assert right(together) > right(alone) and right(together) > 0.93


def test_thresholds_take_whole_bins():
    counts = np.zeros(quality.BINS)
    counts[[0, 10, 20, 6000, quality.BINS - 9, quality.BINS - 1]] = [3, 3, 3, 50, 4, 9]
    assert quality.thresholds(counts, 6, 0.95) == (quality.BINS - 1, 19)  # nine rows of one bin are told together
    assert quality.thresholds(counts, 13, 0.95)[0] < quality.BINS - 8
    sure_bin = int(quality.bins(np.array([np.log(19)]))[0])
    assert quality.thresholds(counts, 1000, 0.95)[0] == sure_bin + 1  # never less sure than asked


def test_told_as_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    teachers = [quality.Teacher(quality.Logistic(np.zeros(3), np.ones(3), rng.normal(size=4) * 3), 4500 + 100 * k, 3600) for k in range(3)]
    for row, got in zip(x, quality.told(x, teachers)):
        wanted = None
        for t in teachers:
            raw = sum(float(np.clip(v, -5, 5)) * w for v, w in zip(row, t.model.weights)) + t.model.weights[3]
            at = min(quality.BINS - 1, max(0, int((raw + quality.BOUND) * quality.BINS / (2 * quality.BOUND))))
            wanted = 1.0 if at >= t.high else 0.0 if at <= t.low else None
            if wanted is not None:
                break
        assert (wanted is None and np.isnan(got)) or wanted == got


def test_rounds_on_spark_as_in_memory(spark, monkeypatch):
    """All unlabelled rows, told apart by plain Python, give the model that the passes on Spark give."""
    monkeypatch.setattr(quality, "FAN", 2)
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    labels = labels.where("doc_id % 3 > 0")
    table = quality.view_table(docs.repartition(5))
    got = quality.train(table, labels)
    votes = {r["id"]: r["y"] for r in quality.majority(labels).collect()}
    rows = [(votes.get(r["id"]), *(np.frombuffer(r[c], np.float16).astype(float) for c in "ab"), bytes(r["a"]), bytes(r["b"])) for r in table.collect()]
    assert quality.unlabelled(table, quality.majority(labels)).count() == sum(r[0] is None for r in rows)
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (zlib.crc32(r[3]), r[3], r[4], r[0]))
    free, y = [r for r in rows if r[0] is None], np.array([r[0] for r in known])
    sizes = [(np.stack([r[k] for r in rows]).mean(0), np.stack([r[k] for r in rows]).std(0) + 1e-6) for k in (1, 2)]
    pool = quality.HeldPool(tuple(np.stack([r[k] for r in free]) for k in (1, 2)))
    wanted = quality.co_train(tuple(np.stack([r[k] for r in known]) for k in (1, 2)), y, float(np.mean(y)), pool, sizes)
    for a, b in ((got.text, wanted.text), (got.page, wanted.page)):
        assert np.allclose(a.weights, b.weights, rtol=1e-3, atol=1e-4)


def test_labelled_ids_are_not_broadcast(spark, monkeypatch):
    """The planner took the multiplied ids for a small table and sent them through the driver; ids of all rows could follow."""
    ids = spark.range(50).selectExpr("id", "unhex(hex(id)) AS a", "unhex(hex(id)) AS b")
    votes = quality.majority(spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality"))
    seen = []
    monkeypatch.setattr(quality, "materialize", lambda df, label: seen.append(df) or df)
    assert quality.unlabelled(ids, votes).count() == 10
    rows, prior = quality.sample(ids, votes)
    assert prior == 0.5 and rows.count() == 40
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    chosen = rows._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in chosen and not re.search("BroadcastHashJoin.*LeftSemi", chosen)


def test_clashing_names_stay(spark):
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)], "doc_id long, quality int")
    rows = [(k, f"some good words number {k} here" if k < 40 else "JUNK!! " * (k % 7 + 5), "en", "s", 9, k, "x", "y", 1) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, a string, b string, _judged int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(40))


def test_quality_edges(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.assess(awkward, none).collect()
    assert len(got) == awkward.count() and all(r["keep"] and r["score"] is None for r in got)
    assert quality.keep_good(awkward, none).count() == awkward.count()
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    plain = [(k, f"some good words number {k} here", "en", "s", 9) if k < 40 else (k, "JUNK!! " * (k % 7 + 5), "en", "s", 9) for k in range(80)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(awkward.select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars").toDF(*docs.columns))
    judged = {r["doc_id"]: r["keep"] for r in quality.assess(both, labels).collect()}
    assert all(judged[k] == (k < 40) for k in range(80))
    assert quality.assess(nothing, labels).count() == 0
    again = {r["doc_id"]: r["keep"] for r in quality.assess(both.repartition(7), labels).collect()}
    assert again == judged


# ------------------------------------------------------------------ search


def plain_search(docs, queries, k):
    tf = [(d, Counter(search.words(t))) for d, t in docs]
    length = [sum(c.values()) for _, c in tf]
    mean, n = sum(length) / max(1, len(docs)), len(docs)
    df = Counter(w for _, c in tf for w in c)
    found = []
    for q, text in queries:
        scored = []
        for (d, c), size in zip(tf, length):
            s = sum(
                m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
                for w, m in Counter(search.words(text)).items() if w in c
            )
            if s > 0:
                scored.append((-round(s, 9), d is None, d or 0))
        found += [(str(q), r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scored)[:k])]
    return found


@pytest.mark.parametrize("table,every", [("documents", 20), ("awkward", 1)])
def test_search_as_brute_force(table, every, request, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "build_index", lambda docs, f=search.build_index: f(docs, shard_docs=37))
    docs = request.getfixturevalue(table)
    queries = docs.where((F.col("doc_id") % every == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("query_id"), "text").dropDuplicates(["query_id"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_search(rows, [(r["query_id"], r["text"]) for r in queries.collect()], 5)
    got = search.top_k(docs, queries, k=5, block_terms=400).collect()
    by_place = {(str(r["query_id"]), r["rank"]): (r["doc_id"], r["score"]) for r in got}
    assert len(got) == len(want)
    for q, rank, d, s in want:
        assert by_place[q, rank] == (d, pytest.approx(s, abs=1e-6))


def test_shards_are_read_one_at_a_time(spark, documents, monkeypatch):
    """All shards of a file were read at once and sent to Python in one batch."""
    index = search.build_index(documents.coalesce(1), shard_docs=30)
    files = index.groupBy(F.input_file_name()).count()
    assert index.count() == files.count() == -(-documents.count() // 30)

    def watched(*given, make=search._searcher):
        def run(batches):
            def alone():
                for batch in batches:
                    assert batch.num_rows == 1
                    yield batch

            return make(*given)(alone())

        return run

    monkeypatch.setattr(search, "build_index", lambda docs: index)
    monkeypatch.setattr(search, "_searcher", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked = documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    assert search.top_k(documents, asked, k=3).count() == 3 * asked.count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_blocks_are_skipped():
    """A block whose maxima do not reach the floor is never read."""
    n, rng = 4096, np.random.default_rng(0)
    postings = np.sort(rng.choice(n, 160, replace=False)).astype(np.int32)  # rarer than a frequent term
    counts = np.ones(160, np.int32)
    counts[postings < 64] = 50
    shard = search.Shard(np.arange(n), np.full(n, 100), np.array([7]), np.array([0, 160]), postings, counts, 100.0)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    shard.postings = shard.postings.view(Watched)
    k = int((postings < 64).sum())
    best, _ = next(iter(shard.search([(np.array([7]), np.array([1.0]), 0.0)], k)))
    assert sorted(best.tolist()) == postings[postings < 64].tolist() and sum(read) < 160 / 3


def test_search_of_nothing(awkward, nothing):
    asked = awkward.select(F.col("doc_id").alias("query_id"), "text")
    assert search.top_k(nothing, asked).count() == 0
    assert search.top_k(awkward, asked.limit(0)).count() == 0
