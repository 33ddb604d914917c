"""URL rules, filter audit and Merkle manifest against plain single-machine versions, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from riskgrid.llm import filteraudit, merkle, urlfilter
from riskgrid.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, key string, keys string, hits int, best string, host int, path int, listed int"


def plain_verdict(url, rules, words=urlfilter.HOST_WORDS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [
        (len(h) + len(p), h.count("."), action == "block", h + p, action)
        for action, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fit:
        return host, path, max(fit)[3], max(fit)[4]
    return host, path, None, "block" if set(re.split(r"[.\-]", host)) & set(words) else "allow"


def urls():
    pick = random.Random(5)
    hosts = ["net", "a.net", "example.net", "WWW.Example.Net", "blog.x.example.com", "example.com", "org", "x.org", "casino-win.io", "pills.io", "xnet", "", ".net", "a..net", "net.", "a.net:80", "é.org", "example.netx"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/1.html", "/fr/?q=/de/", "?x=://net/", "#top", "/fr/#/en/", "/\U0001f600/en/", "//en/"]
    made = [f"{pick.choice(['http', 'https', 'x://'])}://{h}{p}" for h in hosts for p in paths]
    return [None, "", "net/", "://", "://net/", "no scheme", "http://" + "a." * 5000 + "net/" + "en/" * 5000, *made, *made[:9]]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k if k % 7 else None, u, "x", "x", "x", 1, "x", 1, 1, 1) for k, u in enumerate(urls())]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def found(df):
    return Counter(tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect())


@pytest.mark.parametrize("keys_per_filter", [500_000, 3])
def test_urls_as_by_plain_rules(spark, pages, keys_per_filter):
    """Null, empty, hostless and very long urls, repeated rows, columns named as the operator's own; one cascade or many."""
    want = Counter((k if k % 7 else None, *plain_verdict(u, URL_RULES)) for k, u in enumerate(urls()))
    words = urlfilter.HOST_WORDS if keys_per_filter > 3 else ("casino", "pills", "win", "io")
    if keys_per_filter == 3:
        want = Counter((k if k % 7 else None, *plain_verdict(u, URL_RULES, words)) for k, u in enumerate(urls()))
    assert found(urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES), words, keys_per_filter)) == want


def test_url_rules_ties_and_none(spark, pages):
    rules = [("block", "net", "/en/"), ("allow", "NET", "/en/"), ("allow", "a.net", ""), ("block", "org", ""), ("allow", "", "/"), ("deny", "com", "/")]
    got = found(urlfilter.judge(pages, urlfilter.rule_table(spark, [*rules, rules[0]]), ()))
    kept = [(a, h.lower(), p) for a, h, p in rules if h and a != "deny"]
    assert got == Counter((k if k % 7 else None, *plain_verdict(u, kept, ())) for k, u in enumerate(urls()))
    assert found(urlfilter.judge(pages, urlfilter.rule_table(spark, []), ())) == Counter((k if k % 7 else None, *plain_verdict(u, [], ())) for k, u in enumerate(urls()))


def test_urls_of_nothing(spark, pages):
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark, URL_RULES)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    """20,000 keys of which 300 are listed: several levels, and no wrong answer."""
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 67 == 0).alias("listed")).cache()
    levels = urlfilter.build_cascade(universe)
    assert len(levels) > 2 and levels[0][0] > 1 and all(hashes == 1 for hashes, _ in levels[1:])
    assert universe.where(urlfilter.is_listed(levels, F.col("key")) != F.col("listed")).count() == 0
    listed = universe.where("listed").count()
    assert sum(64 * len(words) for _, words in levels) < listed * (math.log2(20_000 / listed) + 8)


@pytest.mark.parametrize("listed", [True, False])
def test_cascade_of_one_side(spark, listed):
    universe = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit(listed).alias("listed"))
    levels = urlfilter.build_cascade(universe)
    assert universe.where(urlfilter.is_listed(levels, F.col("key")) != F.col("listed")).count() == 0


def plain_audit(docs, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    rows = []
    for r in docs:
        text, i = r["text"] or "", r["doc_id"]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        copy = i is not None and any(o["doc_id"] is not None and o["doc_id"] < i and (o["text"] or "") == text for o in docs)
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
        known = i is not None
        rows.append((r["lang"] or "", {f for f, t in zip("ABCDE", tests) if t}, int(known and i in good), int(known and i in toxic)))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in rows if r[0] == part)
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, "".join(order), step] = (len(left), len(gone), fails - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] += len(gone)
    return {(k + v + (shapley[k[0], k[1][k[2] - 1]],)) for k, v in out.items()}


LABELS = "doc_id long, quality int, toxic int, good int, hot boolean, mask int"


@pytest.fixture(scope="module")
def some_labels(spark):
    rows = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, 1, 1), (9, 1, 1), (None, 1, 1), (10, None, None), (14, 0, 1), (14, 0, 1), (77, 1, 1)]
    return spark.createDataFrame([(*r, 7, True, 7) for r in rows], LABELS)


def audited(df):
    return {tuple(r) for r in df.collect()}


def test_audit_as_by_trying_all_orders(spark, awkward, some_labels):
    extra = awkward.withColumns({c: F.lit(3) for c in ("mask", "docs", "good", "toxic", "part", "digest", "hot", "total")})
    got = filteraudit.audit_documents(extra, some_labels)
    assert got.count() == 600 * 3 and audited(got) == plain_audit(awkward.collect(), some_labels.collect())


def test_audit_of_hot_ids_and_copies(spark, some_labels, monkeypatch):
    monkeypatch.setattr(filteraudit, "HOT_IDS", 4)
    rows = [(9, "a b", "en")] * 30 + [(9, f"c{k} $", "de") for k in range(10)] + [(None, "a b", "en")] * 9 + [(k, "A " * 200, None) for k in range(5)] + [(3, "a b", "fr"), (12, "a b", "de"), (2, None, "de"), (1, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audited(filteraudit.audit_documents(docs, some_labels)) == plain_audit(docs.collect(), some_labels.collect())


def test_audit_of_nothing(nothing, some_labels, awkward):
    assert filteraudit.audit_documents(nothing, some_labels).count() == 0
    assert audited(filteraudit.audit_documents(awkward, some_labels.limit(0))) == plain_audit(awkward.collect(), [])


def test_intervals_cover_each_order_once_for_a_mask():
    ranks = math.factorial(4)
    for mask in range(1, 16):
        total = [0] * (ranks + 1)
        for m, _, rank, sign in filteraudit.intervals(4):
            if m == mask:
                total[rank] += sign
        held, at = 0, []
        for change in total:
            held += change
            at.append(held)
        assert at == [1] * ranks + [0]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, run=2):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: digest(*[said(r[c] + add if c == "n_chars" and r[c] is not None else r[c]) for c in merkle.FIELDS])

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + run]) for i in range(0, len(levels[-1]), run)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            start = i // run * run
            yield level[start:i], level[i + 1 : start + run]
            i //= run

    trees = []
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, tree([leaf(r) for r in own])))
    top, out = tree([levels[-1][0] for _, levels in trees]), []
    for k, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            way = [*path(levels, i), *path(top, k)]
            h = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for left, right in way:
                h = digest(*left, h, *right)
            proof = digest(*[x for left, right in way for x in left + right])
            out.append((r["doc_id"], leaf(r), levels[-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return Counter(out)


def proofs(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("run, levels, rows_per_range", [(2, 5, 50_000), (2, 1, 4), (3, 2, 5), (2, 3, 1)])
def test_manifest_as_by_plain_trees(awkward, run, levels, rows_per_range):
    extra = awkward.withColumns({c: F.lit(3) for c in ("leaf", "tampered", "nth", "rank", "tree", "top", "all", "_n", "_range", "crown")})
    got = merkle.manifest(extra, run, levels, rows_per_range)
    assert proofs(got) == plain_manifest(awkward.collect(), run)


def test_manifest_of_many_tiers(spark, documents):
    got = merkle.manifest(documents, 2, 2, 16)
    want = plain_manifest(documents.collect())
    assert proofs(got) == want and 0 < sum(n for row, n in want.items() if not row[-1]) < sum(want.values()) / 4


def test_manifest_of_one_row_one_lang_and_nothing(spark, nothing, awkward):
    assert merkle.manifest(nothing).count() == 0
    for part in (awkward.where("doc_id = 5"), awkward.where("lang = 'de'"), awkward.where("doc_id = 9"), awkward.where("doc_id IS NULL")):
        assert proofs(merkle.manifest(part)) == plain_manifest(part.collect())


def test_manifest_of_one_hot_row(spark):
    rows = [(7, "same", "en", "a", 4)] * 40 + [(k, f"t{k}", "en", None, None) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert proofs(merkle.manifest(docs, 2, 2, 8)) == plain_manifest(docs.collect())
