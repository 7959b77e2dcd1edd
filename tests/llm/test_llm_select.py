"""Resampling, URL filters and centroids against plain definitions."""

import hashlib
import math
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest
from conftest_llm import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantframe.llm import centroids, resample, url_filter
from quantframe.llm.common import shared

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_resample", "op12_url_filter", "op13_centroids"])
def test_query_matches_sql(spark, name):
    from oracle_check import connect, rows_of

    from quantframe.llm.queries_select import ORACLES, QUERIES

    df = QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


# Resampling


@given(st.lists(st.binary(min_size=1, max_size=40), max_size=30))
@settings(deadline=None, max_examples=60)
def test_crc_of_short_features(features):
    assert resample.crc_buckets(features, 1 << 20).tolist() == [crc32(f) % (1 << 20) for f in features]


@pytest.mark.parametrize("length", [511, 512, 513, 1024, 1500, 100_003])
def test_crc_of_long_features(length):
    rows = [random.Random(i).randbytes(length) for i in range(3)]
    got = resample.matrix_crc(np.frombuffer(b"".join(rows), np.uint8).reshape(3, -1))
    assert got.tolist() == [crc32(r) for r in rows]


def plain_features(text, longest):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [crc32(r.encode()) % 10_000 for r in runs]


TEXTS = [t for _, t in AWKWARD] + ["A b-C d_e f9 É", "x1 y2 " * 50, "straße STRASSE \x00\x7f ok"]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("slice_size", [8, 1 << 20])
def test_runs_are_those_of_the_definition(monkeypatch, longest, slice_size):
    monkeypatch.setattr(resample, "_SLICE", slice_size)
    monkeypatch.setattr(resample, "_KNOWN", 40)
    texts = [t[:2000] if t else t for t in TEXTS]
    found = {i: ([], 0) for i in range(len(texts))}
    for owner, buckets, worded in resample.Bucketer(longest, 10_000).runs(texts):
        for i, b in zip(owner.tolist(), buckets.tolist()):
            found[i][0].append(b)
        for i in worded.tolist():
            found[i] = (found[i][0], found[i][1] + 1)
    for i, t in enumerate(texts):
        words, buckets = plain_features(t, longest)
        assert found[i][1] == len(words)
        assert sorted(found[i][0]) == sorted(buckets)


def test_resampling_by_definition(spark, table):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60)))) for i in range(150)] + AWKWARD
    docs = table(rows, "rank", "bin", "place", "row_number", "part", "begin")
    target = table([(i, " ".join(rnd.choices(vocabulary[:9], k=30))) for i in range(20)])
    source_n, target_n = ([0] * 10_000 for _ in range(2))
    for _, t in rows:
        for b in plain_features(t, 1)[1]:
            source_n[b] += 1
    for r in target.collect():
        for b in plain_features(r["text"], 1)[1]:
            target_n[b] += 1
    gain = resample.gains(resample.bucket_counts(docs), resample.bucket_counts(target))
    s, t = sum(source_n) + 10_000, sum(target_n) + 10_000
    want = [math.floor(1000 * math.log((y + 1) * t**-1 * s / (x + 1))) for x, y in zip(source_n, target_n)]
    assert np.abs(gain - np.array(want)).max() <= 1 and (gain != np.array(want)).mean() < 1e-3
    scored = shared(
        resample.with_weights(docs, gain)
        .withColumn("score", F.col("importance.weight") + resample.perturbation(F.col("doc_id"), 5))
        .drop("text")
    )
    eligible = F.col("importance.n_words") >= resample.MIN_WORDS
    out = resample.draw(scored, "score", "doc_id", eligible, 30)
    assert out.columns == [c for c in scored.columns if c != "rank"] + ["rank"]
    got = out.collect()
    assert len(got) == len(rows)
    plain = {}
    for i, text in rows:
        words, buckets = plain_features(text, 1)
        h = int(hashlib.sha256(f"5:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(int(gain[b]) for b in buckets)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        plain.setdefault(i, []).append((weight + noise, len(words)))
    for r in got:
        assert (r["score"], r["importance"]["n_words"]) in plain[r["doc_id"]]
    able = sorted(
        (r for r in got if r["importance"]["n_words"] >= 20),
        key=lambda r: (-r["score"], r["doc_id"] is not None, r["doc_id"]),
    )
    k = 30 * len(able) // 100
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, k + 1))
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(r["score"], r["doc_id"]) for r in able[:k]]


def test_equal_scores_are_ranked_across_partitions(spark):
    rows = spark.range(2000).selectExpr("id % 7 as doc_id", "5L as score", "true as fit")
    out = resample.draw(shared(rows), "score", "doc_id", F.col("fit"), 50).collect()
    ranked = sorted((r["rank"], r["doc_id"]) for r in out if r["rank"])
    assert [r for r, _ in ranked] == list(range(1, 1001))
    assert [d for _, d in ranked] == sorted(d for _, d in ranked)


def test_no_rows_and_no_target(spark, table):
    gain = resample.gains(resample.bucket_counts(table([])), resample.bucket_counts(table([])))
    assert not gain.any()
    scored = shared(resample.with_weights(table([]), gain).selectExpr("doc_id", "importance.weight as score"))
    assert resample.draw(scored, "score", "doc_id", F.lit(True), 10).count() == 0


def test_one_word_of_a_long_text_is_linear():
    def seconds(n):
        begin = time.perf_counter()
        list(resample.Bucketer(1, 10_000).runs(["x" * n, "y " * n]))
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(2_000_000) < 40 * max(seconds(200_000), 0.05)


# URL filters

URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "https://net/",
    "https://notnet/", "http://www.example.net/en/a/b?q=/en/", "http://example.net/en", "http://example.net/english/",
    "http://example.com/de/x#y", "http://x.example.com/de/", "http://example.com/d", "http://a.org/fr/1",
    "http://org/fr/", "http://a.org/", "http://a.net:80/", "http://u@a.net/", "x://y://a.net/z", "http://a..net/",
    "http://.net/", "http://net./", "http://a.net/\nb", "http://" + "a." * 30_000 + "net/" + "b/" * 30_000,
]


def parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(rules, host, path):
    fits = [
        (len(h) + len(p), len(h), h + p, a)
        for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[2:] if fits else (None, None)


def rule_list(seed):
    rnd = random.Random(seed)
    hosts = ["net", "example.net", "a.example.net", "com", "b.com", "", "x", "x.net"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/a/", "/e", "/en/ab/c", "en"]
    return [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(25)]


def random_urls(seed):
    rnd = random.Random(seed)
    hosts = ["net", "example.net", "a.example.net", "z.a.example.net", "b.com", "com", "", "q", "x.net", "a.x"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/ab/c/d", "/english", "/e", "/en/a/b", "//", "/x//en/"]
    return [f"{rnd.choice(['http', 'x'])}://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(150)]


@pytest.mark.parametrize("most", [100_000, 0], ids=["trie", "join"])
@pytest.mark.parametrize("seed", [None, 1, 2])
def test_verdicts_by_definition(spark, most, seed):
    from quantframe.llm.queries_select import RULES

    rules = RULES if seed is None else rule_list(seed)
    urls = URLS if seed is None else random_urls(seed)
    names = ["host", "path", "action", "rule", "url_host_", "url_path_", "url_found_", "filtered"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    pages = pages.selectExpr("*", *[f"'mine' as {n}" for n in names])
    if seed is None:
        pages = pages.withColumn("url", F.when(F.col("page_id") >= 0, F.col("url")))
    listed = spark.createDataFrame(rules, "host string, path string, action string")
    out = url_filter.with_verdict(pages, listed, max_rules=most, default="block")
    assert sorted(out.columns) == sorted(pages.columns)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = parts(url)
        rule, action = plain_rule(rules, host, path)
        f = got[i]["filtered"]
        assert (f["host"], f["path"], f["rule"], f["verdict"]) == (host, path, rule, action or "block"), url
        assert got[i]["host"] == "mine"


def test_lists_of_rules_that_are_empty_or_odd(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id bigint, url string")
    schema = "host string, path string, action string"
    for most in (10, -1):
        out = url_filter.with_verdict(pages, spark.createDataFrame([], schema), max_rules=most)
        assert [r["filtered"]["verdict"] for r in out.collect()] == ["allow", "allow"]
        empty = url_filter.with_verdict(pages.limit(0), spark.createDataFrame([(None, None, "block")], schema))
        assert empty.count() == 0
    with pytest.raises(ValueError, match="neither"):
        url_filter.with_verdict(pages, spark.createDataFrame([("a", "/", None)], schema))


# Centroids


def plain_kmeans(rows, k, rounds, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = np.array([v for _, v in first], dtype=np.int64)
    x = np.array([v for _, v in kept], dtype=np.int64)

    def near():
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = near()
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0) // (own == j).sum()
    own, d = near()
    return [(i, int(a), int(b)) for (i, _), a, b in zip(kept, own, d)], c


def vectors(seed, n, dims, groups):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(groups, dims))
    return [(i, (middles[rnd.integers(groups)] + 0.2 * rnd.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed, groups", [(1, 3), (2, 12), (3, 1)])
def test_clusters_by_definition(spark, seed, groups):
    rows = vectors(seed, 600, 8, groups)
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(2000 + i, [0.0] * 8) for i in range(9)]
    odd = [
        (3001, None), (3002, [1.0] * 7), (3003, [1.0] * 9), (3004, [None] + [1.0] * 7),
        (3005, [math.nan] * 8), (3006, [math.inf] + [0.0] * 7), (3007, []),
    ]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(5)
    names = ["ints", "cluster", "cluster_before", "upper", "lower", "distance"]
    df = df.selectExpr("*", *[f"'mine' as {n}" for n in names])
    out, last = centroids.cluster_vectors(df, 12, 5, 2, 8)
    assert out.columns == ["vec_id", *names, "clustered"]
    want, c = plain_kmeans(rows, 12, 5, 2)
    got = sorted((r["vec_id"], r["clustered"]["cluster"], r["clustered"]["distance"]) for r in out.collect())
    assert got == sorted(want)
    assert last.tolist() == c.tolist()


def test_bounds_hold_and_spare_scans():
    rnd = np.random.default_rng(5)
    v = np.array([x for _, x in vectors(5, 3000, 16, 10)])
    v = np.floor(256 * v).astype(np.int64)
    c = v[rnd.choice(len(v), 10, replace=False)]
    own, up, low = np.full(len(v), -1), np.full(len(v), np.inf), np.zeros(len(v))
    step, scanned, full = centroids.step_to(c, None, None), [], 0
    for _ in range(12):
        own, up, low, n = centroids.assign(v, own, up, low, step)
        scanned.append(n)
        d = np.sqrt(centroids.squared(v, c).astype(float))
        assert (own == d.argmin(1)).all()
        at = np.arange(len(v))
        assert (up >= d[at, own] * (1 - 1e-12)).all()
        d[at, own] = np.inf
        assert (low <= d.min(1) * (1 + 1e-12)).all()
        old, radius = c, np.array([up[own == j].max(initial=0) for j in range(10)])
        c = np.array([v[own == j].sum(0) // max((own == j).sum(), 1) for j in range(10)])
        step = centroids.step_to(c, old, radius)
        full = np.sqrt(((c - old) ** 2).sum(1)).max()
        assert (step.drop <= full * (1 + 1e-6)).all()
        if full:
            assert step.drop.mean() < full
    assert scanned[-1] < scanned[0] / 4


@given(st.integers(0, 10_000))
@settings(deadline=None, max_examples=200)
def test_no_member_of_the_sphere_loses_more_than_the_drop(seed):
    rnd = np.random.default_rng(seed)
    dims = int(rnd.integers(1, 5))
    old = rnd.normal(size=(3, dims)) * 10
    new = old + rnd.normal(size=(3, dims)) * rnd.choice([0.01, 1, 20])
    radius = np.abs(rnd.normal(size=3)) * rnd.choice([0.1, 3, 30])
    drop = centroids.drops(old, new, radius)
    way = rnd.normal(size=(400, dims))
    way /= np.linalg.norm(way, axis=1)[:, None]
    for i in range(3):
        x = old[i] + way * radius[i] * rnd.random((400, 1)) ** 0.2
        for j in {0, 1, 2} - {i}:
            lost = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
            assert lost.max() <= drop[i] + 1e-9


def test_vectors_beyond_exact_doubles_and_few_rows(spark):
    rows = [(1, [1e300, -1e300]), (2, [3e5, 4e5]), (2, [3e5, 4e5]), (3, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out, last = centroids.cluster_vectors(df, 40, 3, 2, 2)
    got = out.collect()
    assert len(got) == 4 and len(last) == 4 and all(r["clustered"]["distance"] == 0 for r in got)
    assert {r["clustered"]["cluster"] for r in got if r["vec_id"] == 2} != set()
    sums = centroids.inertia(out.select("clustered.*"), last).collect()
    assert {r["inertia"] for r in sums} == {0}
    empty, last = centroids.cluster_vectors(df.limit(0), 40, 3, 2, 2)
    assert empty.count() == 0 and len(last) == 0
    assert centroids.inertia(empty.select("clustered.*"), last).count() == 0
