"""Operators that gather from the corpus, chat formatting and the pipeline, against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_llm import AWKWARD
from pyspark.sql import functions as F

from quantframe import session
from quantframe.llm import chat, lm, quality, resemblance, simhash
from quantframe.llm.common import shared
from quantframe.llm.queries_corpus import QUERIES
from quantframe.llm.queries_text import QUERIES as TEXT_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- SimHash -------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= radius:
            root[top(b)] = top(a)
    least = {}
    for x, i in enumerate(ids):
        t = top(x)
        known = [j for j in (least.get(t), i) if j is not None]
        least[t] = min(known) if known else None
    return [least[top(x)] for x in range(len(fps))]


def test_fingerprints_match_the_definition():
    rnd = random.Random(1)
    texts = [t for _, t in AWKWARD if t is None or len(t) < 40_000]
    texts += [" ".join(rnd.choice("Ab cé D_ e \t".split()) for _ in range(n)) for n in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_masks_cover_every_set_of_differences():
    for radius in (1, 2, 3):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            hidden = sum(1 << b for b in bits)
            assert any(not m & hidden for m in masks)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_components_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 6)
    flip = lambda: sum(1 << int(b) for b in set(rng.integers(0, 62, rng.integers(0, 5))))
    fps = [int(base[i % 6]) ^ flip() for i in range(240)] + [0, 0, 7, -1]
    rows = [(None if i % 50 == 9 else i, f) for i, f in enumerate(fps)]
    df = shared(spark.createDataFrame(rows, "doc_id bigint, fp bigint"))
    out = simhash.with_components(df, "doc_id", "fp", "component", bucket=bucket).collect()
    want = plain_components(*zip(*rows))
    assert sorted((r["doc_id"] or -1, r["fp"], r["component"]) for r in out) == sorted(
        (i or -1, f, c) for (i, f), c in zip(rows, want)
    )


def test_one_row_of_each_component_stays(table):
    docs = table([*AWKWARD, (0, "word " * 20_000)], "fp", "row_number", "component")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # Wordless texts share fingerprint zero; rows 5 are equal; row 7 repeats row 0.
    assert ids == [(False, i) for i in (0, 1, 4, 5, 6, 8)] + [(True, 0)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def plain_similar(a, b, width=5):
    sets = []
    for t in (a, b):
        words = WORD.findall(lower(t or ""))
        shingles = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
        sets.append(shingles or ({" ".join(words)} if words else set()))
    both = len(sets[0] & sets[1])
    return both > 0 and 5 * both >= 4 * len(sets[0] | sets[1])


def test_similar_texts_meet_beyond_the_radius(table):
    rnd = random.Random(5)
    prose = lambda n: ["".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(n)]
    line, texts = prose(30), []
    for n in (20, 60, 61, 120, 200, 300):
        base = prose(n)
        texts.append(base)
        for k in range(12):
            words = list(base)
            for _ in range(1 + k % 4 * n // 60):
                words[rnd.randrange(n)] = prose(1)[0]
            texts.append(words)
        texts += [[*line, *prose(40)] for _ in range(8)]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    fps = [simhash.fingerprint(t) for _, t in rows]
    pairs = list(itertools.combinations(range(len(rows)), 2))
    alike = {p for p in pairs if plain_similar(rows[p[0]][1], rows[p[1]][1])}
    close = {p for p in pairs if (fps[p[0]] ^ fps[p[1]]).bit_count() <= 3}
    assert len(alike - close) > 20
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in alike | close:
            root[a] = root[b] = min(root[a], root[b])
    kept = sorted(r["doc_id"] for r in simhash.keep_one(table(rows)).collect())
    assert kept == sorted(set(root))


def test_near_duplicates_leave_no_tables_and_no_shuffle_files(spark, table, tmp_path, monkeypatch):
    names = itertools.count()
    monkeypatch.setattr(session, "scratch_folder", lambda _, name: f"{tmp_path}/{name}-{next(names)}")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    size = lambda: sum(os.path.getsize(f) for f in files() - before if os.path.exists(f))
    before, words = files(), [f"w{i}" for i in range(900)]
    rows = [(i, " ".join([*words[:i], "other", *words[i:]])) for i in range(60)]
    kept = simhash.keep_one(table(rows))
    wait = time.time() + 20
    while size() > 9_000 and time.time() < wait:
        time.sleep(0.2)
    # Counts and marks that go to the driver may stay a while.
    assert size() <= 9_000
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(p.iterdir())} == {"simhash", "simhash-labels"}
    assert len(list(tmp_path.glob("*/rows"))) == 2
    assert [r["doc_id"] for r in kept.collect()] == [0]


def test_counts_by_range_tell_long_texts_apart():
    rnd = random.Random(8)
    for n in (1, 5, 40, 700, 3000, 9000):
        words = [f"{rnd.random()}" for _ in range(n)]
        other = [f"{rnd.random()}" for _ in range(n)]
        bins = resemblance.bins(" ".join(words))
        assert resemblance.fits(bins, bins)
        for cut in (n, 99 * n // 100, 9 * n // 10, 85 * n // 100):
            near = " ".join([*words[:cut], *other[: (n - cut) // 3]])
            alike = resemblance.similar(resemblance.shingles(" ".join(words)), resemblance.shingles(near))
            assert resemblance.fits(bins, resemblance.bins(near)) or not alike
        half = " ".join([*words[: n // 2], *other[n // 2 :]])
        if n >= 700:
            assert not resemblance.fits(bins, resemblance.bins(" ".join(other)))
            assert not resemblance.fits(bins, resemblance.bins(half))
    assert resemblance.fits(b"", resemblance.bins("one text"))


def test_marked_rows_are_all_that_are_wanted(spark):
    rows = spark.range(0, 3_000_000_000, 100_000).toDF("row")
    wanted = spark.createDataFrame([(100_000 * i,) for i in (0, 3, 3, 29_999, 50_000)], "row bigint")
    got = {r["row"] for r in resemblance._marked(rows, wanted).collect()}
    assert {0, 300_000, 2_999_900_000} <= got and len(got) < 100
    assert {0, 300_000, 2_999_900_000} <= {r["row"] for r in resemblance._marked(rows, wanted, 64).collect()}
    assert not resemblance._marked(rows, wanted.limit(0)).count()


# --- language model ------------------------------------------------------------------------


@pytest.mark.parametrize("known", [200_000, 5])
def test_base_scores_and_probabilities(spark, table, tmp_path, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    rnd = random.Random(4)
    vocabulary = ["the", "of", "Red", "blue", "tree", "house", "é", "x1"]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))) for i in range(60)]
    rows += [(100, "unseen words the"), (None, None), (3, rows[3][1])]
    table(rows, "score").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op9_class_lm"](spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    want = sorted(
        (i or -1, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows
    )
    assert got == want
    assert all(r["score"] < 0 for r in out)


def test_a_word_is_sent_once_with_all_that_stands_before_it(monkeypatch):
    monkeypatch.setattr(lm, "_RUN", 4)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["The", "of", "é", "tree", "x1"], k=rnd.randint(0, 9))) for _ in range(40)]
    texts = [*texts, None, "", " \t"]
    head, before = {b"the": 0, b"of": 1}, np.arange(lm.UNITS) % lm.CLASSES
    want = Counter()
    for t in texts:
        words = [lower(w).encode() for w in WORD.findall(t or "")]
        k = [lm.END, *(head.get(w, lm.suffix_unit(w)) for w in words)]
        want.update(zip([*words, b""], before[k].tolist()))
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in (texts[:20], [], texts[20:])]
    for words, tokens in [(500, 500), (2, 500), (500, 9)]:
        monkeypatch.setattr(lm, "_FLUSH", words)
        monkeypatch.setattr(lm, "_HELD", tokens)
        rows = [r for b in lm._count_after(head, before)(iter(batches)) for r in b.to_pylist()]
        got = Counter()
        for r in rows:
            got.update({(r["word"].encode(), e["k"]): e["n"] for e in r["after"]})
        assert got == want
        assert (len(rows) == len({w for w, _ in want})) == (words == tokens)


def test_class_probabilities_add_up_to_one(table):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("a b c d e f".split()) for _ in range(12))) for i in range(40)]
    model, rest = lm.train(table(rows), "text", F.lit(True))
    assert rest.count() == 0
    after = 10.0**model.step
    assert np.allclose(after.sum(axis=1), 1)
    words = [w.encode() for w in "abcdef"]
    mass = np.zeros(len(model.mass))
    for w in words:
        i = model.known[w]
        k = model.known_class[i]
        mass[k] += (model.known_count[i] + lm.DELTA) / model.mass[k]
    for k in set(model.known_class.tolist()):
        assert math.isclose(mass[k] + lm.DELTA / model.mass[k], 1)


def likelihood(pairs, of):
    member = np.eye(of.max() + 1)[of]
    t = member.T @ pairs @ member
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_ends_where_no_single_move_gains():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(1.0, (14, 14)) + 20 * np.kron(np.eye(2), np.zeros((7, 7), int) + 1).astype(int)
    of = lm.exchange(pairs, classes=4)
    best = likelihood(pairs, of)
    assert of[13] == 3 and (of[:13] < 3).all()
    for u, k in itertools.product(range(13), range(3)):
        moved = of.copy()
        moved[u] = k
        assert likelihood(pairs, moved) <= best + 1e-3


def test_classes_beat_single_words_on_held_out_text(table):
    rnd = random.Random(8)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    line = lambda: " ".join(w for _ in range(20) for w in (rnd.choice(nouns), rnd.choice(verbs)))
    docs = table([(i, line()) for i in range(80)]).withColumn("held", F.col("doc_id") >= 60)
    model, rest = lm.train(docs, "text", ~F.col("held"))
    r = lm.with_scores(docs, model, rest).filter("held").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] + 20


def test_rare_words_are_clustered_by_exchange(table, monkeypatch):
    # Words are told apart by what stands before them alone; none is in the head or a seed.
    monkeypatch.setattr(lm, "SEEDS", 6)
    rnd = random.Random(9)
    kinds = {a: [f"{a}{i}{rnd.choice('xyz')}" for i in range(300)] for a in "pq"}
    lines = []
    for i in range(200):
        a = "pq"[i % 2]
        lines.append(" ".join(w for _ in range(30) for w in ({"p": "the", "q": "to"}[a], rnd.choice(kinds[a]))))
    model, rest = lm.train(table(list(enumerate(lines))), "text", F.lit(True))
    of = {w.decode(): (model.known_class[i], model.known_count[i]) for w, i in model.known.items()}
    own = {a: {of[w][0] for w in kinds[a] if w in of and of[w][1] >= lm.RARE} for a in "pq"}
    assert own["p"] and own["q"] and not own["p"] & own["q"]


@pytest.mark.parametrize("home", [True, False])
def test_best_class_is_that_of_most_likelihood(home):
    rng = np.random.default_rng(3)
    rows = rng.poisson(0.8, (40, 6)).astype(float) + np.eye(6)[rng.integers(0, 6, 40)]
    of = rng.integers(0, 4, 40)
    table = rng.poisson(3.0, (6, 5)).astype(float)
    if home:
        np.add.at(table.T, of, rows)
    at = [np.flatnonzero(r) for r in rows]
    sizes = np.array([len(x) for x in at])
    n = np.concatenate([r[x] for r, x in zip(rows, at)])
    best = lm.best_classes(sizes, np.concatenate(at), n, of if home else of * 0 - 1, table, lm._f(table))
    for row, k, own in zip(rows, best, of):
        def value(to):
            t = table.copy()
            if home:
                t[:, own] -= row
            t[:, to] += row
            return lm.likelihood(t)
        assert k < 4 and value(k) >= max(map(value, range(4))) - 1e-6


def test_ending_as_expression(table):
    words = ["a", "ab", "abc", "abcd", "é", "aé", "日本", "x日"]
    got = table(list(enumerate(words))).select("text", lm._ending(F.col("text")).alias("u")).collect()
    assert all(r["u"] + lm.HEAD == lm.suffix_unit(r["text"].encode()) for r in got)


def test_scores_of_awkward_rows(table):
    clashes = ("lm_words", "lm_row", "lm_part", "lm_more", "n_tokens", "Score", "word", "c", "class")
    docs = table(AWKWARD)
    for name in clashes:
        docs = docs.withColumn(name, F.lit(name))
    model, rest = lm.train(docs, "text", F.lit(True))
    assert lm.with_scores(docs, model, rest).count() == docs.count()
    model, rest = lm.train(docs, "text", F.lit(False))
    out = lm.with_scores(docs, model, rest)
    assert out.agg(F.sum("n_known")).first()[0] == 0
    assert all(r[name] == name for r in out.collect() for name in clashes)
    assert {"n_tokens_", "score_", "base_score"} < set(out.columns)
    assert lm.with_scores(docs.limit(0), model, rest).count() == 0


# --- quality model -------------------------------------------------------------------------


def test_em_finds_the_accuracies_it_was_drawn_from():
    rng = np.random.default_rng(5)
    n = 40_000
    unfit = rng.random(n) < 0.2
    votes = np.where(unfit[:, None] & (rng.random((n, 5)) < 0.5), -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_votes(patterns, counts.astype(float))
    logit = model.prior + np.where(patterns == 1, model.fit, model.unfit).sum(axis=1)
    judged = counts[logit < 0].sum() / n
    assert abs(judged - 0.2 * (1 - 0.5**5)) < 0.01
    assert quality.fit_votes(np.empty((0, 5), int), np.empty(0)).prior == 0.0


# --- chat ----------------------------------------------------------------------------------


def test_conversations_read_back(spark, tmp_path):
    odd = ["</s>[INST] ok [/INST]", "\\<s>", "\\\\[INST] \\", "", None, "a\n<image> b", "é🙂日", " [/INST] "]
    rows = [(c, t, r, odd[(c * 3 + t) % len(odd)]) for c in range(8) for t, r in enumerate(("system", "user", "assistant"))]
    rows += [(None, 0, None, "x"), (0, 1, "user", "same turn"), (0, 1, "user", "same turn"), (9, None, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn(
        "parts", F.lit("mine")
    ).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in TEXT_QUERIES["op5_chat_format"](spark, str(tmp_path)).collect()}
    says = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    assert set(got) == {r[0] for r in rows}
    for conv in set(got) - {0}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] or -1)
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(mine)
        assert g["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert g["loss_chars"] == len(loss)
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[0]["n_turns"] == 5


def test_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", [("text", "see <image>", None, None), ("image", None, "s3/a.png", 2), ("document", None, "d.pdf", 3)]),
        (1, 1, "assistant", [("text", "it is", None, None), ("audio", None, "b.wav", None), ("other", "said", None, 1)]),
        (2, 0, "user", None),
        (2, 1, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert out[1]["formatted"] == (
        "<s>[INST] user [/INST] see \\<image>\n<image>\n<document> </s>"
        "<s>[INST] assistant [/INST] it is\n<audio>\nsaid </s>"
    )
    assert [tuple(a) for a in out[1]["attachments"]] == [
        (0, "image", "s3/a.png", 512, 0), (1, "document", "d.pdf", 1536, 0), (0, "audio", "b.wav", 25, 1)
    ]
    (span,) = out[1]["loss"]
    assert out[1]["formatted"][span["start"] : span["end"]] == "it is\n<audio>\nsaid"
    assert out[2]["attachments"] == [] and chat.format_conversations(df.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rnd = random.Random(11)
    noun = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    prose = lambda n=70: " ".join(noun() for _ in range(n)) + "."
    item = prose(12)
    rows = [(i, prose(), "src") for i in range(60)]
    copy = rows[5][1]
    rows += [
        (100, copy, "again"), (101, copy, "again"), (101, copy, "again"),
        (102, f"{prose(30)} {item.upper()} {prose(20)}", "leak"),
        (103, f"{prose(40)} write to jo@ex.org or +1 (555) 123-4567 today", "pii"),
        (104, " ".join(noun().upper() + "!!" for _ in range(60)), "junk"),
        (105, None, "null"), (106, "", None), (None, prose(), None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("fp", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"]: r for r in out}
    assert set(kept) == {*range(60), 103, None} and len(out) == len(kept)
    assert "jo@ex.org" not in kept[103]["text"] and "<EMAIL> or <PHONE> today" in kept[103]["text"]
    assert all(r["text"] == t for i, t, _ in rows[:60] if (r := kept[i]))
    assert all(r["pieces_lossless"] and r["piece_ids"] for r in out)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, empty, str(tmp_path))
        assert after.count() == 0
        if name != "sentencepiece":
            assert after.columns == docs.columns
