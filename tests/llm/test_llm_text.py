"""Per-text operators against plain definitions."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest_llm import AWKWARD
from pyspark.sql import functions as F

from quantframe.llm import decontam, html_text, pieces, pii, quality, secret_scan, tokens
from quantframe.llm.common import meets
from quantframe.llm.queries_text import QUERIES, piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fuzz(parts, n, size, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, size))) for _ in range(n)]


# --- personal data -------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_pii(text):
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and plain_luhn(d),
        "phone": lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15,
    }
    return sorted(
        (m.start(), pii.RANK[k], k, m.end())
        for k, p in BASE.items()
        for m in p.finditer(text)
        if keep[k](m[0])
    )


def test_pii_base_spans_match_the_patterns():
    texts = fuzz(list("a@b.@1 2-3+4.5(60_%é"), 8000, 60) + fuzz(
        ["4111111111111111", "1.2.3.4", " ", ".", "-", "+1", "256", "a@b.c", "@", "5", "(0)"], 8000, 12
    )
    for t in texts:
        got = [
            (s, pii.RANK[k], k, e) for s, e, k, _, _ in pii.find_spans(t) if k in pii.BASE_KINDS
        ]
        assert got == plain_pii(t), t


def test_pii_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    kinds = lambda t: [k for _, _, k, _, _ in pii.find_spans(t)]
    assert kinds("my IBAN: GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("my IBAN: GB83 WEST 1234 5698 7654 32 ok") == []
    assert kinds("phone 030 1234567 please") == ["local_phone"]
    assert kinds("serial 030 1234567 order") == []


def test_pii_masks_and_survives_awkward_rows(table):
    docs = table([*AWKWARD, (9, "mail a@b.co or 1.2.3.4")], "pii_spans")
    out = pii.mask_pii(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[9] == "mail <EMAIL> or <IP>" and rows[1] is None and rows[6] == "x" * 30_000
    spans = pii.with_pii(docs)
    assert spans.columns == [*docs.columns, "pii_spans_"] and spans.count() == docs.count()
    assert pii.mask_pii(docs.limit(0)).count() == 0


def test_account_numbers_before_capital_words():
    found = lambda t: [t[s:e] for s, e, k, _, _ in pii.find_spans(t) if k == "iban"]
    be, es, no = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "NO93 8601 1117 947"
    for one in (be, es, no):
        for after in ("", " BIC", " EUR", " AND MORE", ".", " x", " BIC " + one, " " + one):
            assert found(f"IBAN {one}{after}") == [one] * (1 + (one in after))
        assert found(f"IBAN {one[:-1]}{(int(one[-1]) + 1) % 10} BIC") == []
        assert found(f"IBAN {one}7 BIC") == []


def test_meets_is_an_overlap():
    rnd = random.Random(12)
    pick = lambda: tuple(sorted(rnd.sample(range(40), 2)))
    for _ in range(200):
        spans = [pick() for _ in range(rnd.randint(0, 6))]
        test = meets(spans)
        for s, e in (pick() for _ in range(20)):
            assert test(s, e) == any(a < e and s < b for a, b in spans)


def test_many_spans_and_deep_pages_take_linear_time():
    phones = "4111 1111 1111 1111, 030 1234567. "
    keys = f"token={'ab' * 8} {'k7Qz' * 9} "
    deep = lambda n: "<div>" * n + "<p>text</p>" + "</div>" * n
    table = lambda n: "<p><table>" + "<div>" * n + "x"
    ratio = np.zeros((secret_scan.SYMBOLS + 1,) * 2)
    for run, size in (
        (lambda n: pii.find_spans(phones * n), 2_000),
        (lambda n: secret_scan.find_spans(keys * n, ratio), 2_000),
        (lambda n: html_text.parse(deep(n)), 10_000),
        (lambda n: html_text.parse(table(n)), 10_000),
    ):
        times = []
        for n in (size, 4 * size):
            start = time.perf_counter()
            run(n)
            times.append(time.perf_counter() - start)
        assert times[1] < 10 * times[0] + 0.2


def test_closing_reaches_the_innermost_open_tag():
    tree = html_text.parse("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><p>f<table><tr><td>g<td>h<p>i<div>j")
    above = lambda n: [] if n < 0 else [n, *above(tree.parent[n])]
    assert [t for _, t in tree.blocks] == list("abcdefghij")
    depth = {t: len(above(n)) for n, t in tree.blocks}
    assert depth == {"a": 3, "b": 5, "c": 5, "d": 3, "e": 3, "f": 2, "g": 4, "h": 4, "i": 5, "j": 5}


def test_pii_long_runs_are_linear():
    pii.find_spans("a" * 400_000 + "1" * 400_000 + "+1" * 100_000 + "@" * 100_000)


# --- secrets -------------------------------------------------------------------------------


def plain_secrets(text):
    key = "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" for c in k)
        for k in ("password", "passwd", "secret", "token", "api_key")
    )
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_base_spans_match_the_patterns():
    parts = ["password", "PassWD", "token", "ſecret", "api_key", "apiKey", " ", "=", ":", '"', "'"]
    for t in fuzz([*parts, "abcd", "AKIA", "ABCD1234", "0123abcd", "x", "é", ".", "/"], 12000, 16):
        got = sorted((s, secret_scan.RANK[k], e) for k, s, e in secret_scan.base_spans(t))
        assert got == plain_secrets(t), t


def test_secret_model_tells_random_from_names(spark, table):
    rnd = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    syllables = ["get", "user", "name", "index", "value", "count", "table", "read", "file", "open"]
    name = lambda: "_".join(rnd.choice(syllables) for _ in range(5)) + str(rnd.randint(1, 9))
    rows = [(i, f"password = {secret(32)} and {name()} then {name()}") for i in range(400)]
    ratio = secret_scan.train(table(rows))
    hits = lambda words: sum(bool(secret_scan.find_spans(w, ratio)) for w in words)
    assert hits([secret(32) for _ in range(200)]) >= 190
    assert hits([name() for _ in range(200)]) <= 4


def test_secret_awkward_rows(table):
    docs = table(AWKWARD, "secret_spans")
    out = secret_scan.with_secrets(docs, secret_scan.train(docs))
    assert out.columns == [*docs.columns, "secret_spans_"] and out.count() == docs.count()
    ratio = secret_scan.train(docs.limit(0))
    assert not ratio.any()
    assert secret_scan.find_spans("A1b2C3d4E5f6G7h8I9j0K1", ratio) == []


# --- quality -------------------------------------------------------------------------------


def plain_measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {
        i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)
    }
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), symbols, dup, len(repeated), sum(map(len, words))


def test_quality_measures_match_the_definition():
    for t in fuzz(["a ", "b ", "\n", "c\t", "é ", "  ", "a\n", "\x0b", "\x85", "#", "日 "], 6000, 40):
        assert quality.measure(t)[:5] == plain_measures(t), t
    assert quality.measure(None) == quality.measure("") == (0,) * len(quality.MEASURES)


def test_quality_keeps_prose_and_drops_junk(table):
    rnd = random.Random(3)
    noun = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    prose = [(3000 + i, " ".join(noun() for _ in range(70)) + ".") for i in range(200)]
    shout = [(1000 + i, " ".join(noun().upper() + "!!" for _ in range(60))) for i in range(20)]
    marks = [(2000 + i, " ".join(noun() + "###" for _ in range(60))) for i in range(20)]
    docs = table([*prose, *shout, *marks, *AWKWARD], "quality_measures")
    kept = quality.keep_fit(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & {i for i, _ in prose}) >= 198
    assert not ids & {i for i, _ in [*shout, *marks]} and not ids & {1, 2, 3, 4, 7}
    assert quality.keep_fit(docs.limit(0)).count() == 0


# --- tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return definition, Tokenizer.from_str(definition)


def test_token_counts_equal_the_library(library):
    definition, known = library
    own = tokens.Tokenizer(definition, tokens.character_classes(definition))
    parts = "a ' s t r e v l m d é ñ ! ? 日 1 23 'll 're the == ́ 🙂 \x00 \x85 <|endoftext|>".split(" ")
    texts = fuzz([*parts, " ", " ", "\n", "\t", "  ", " ing"], 6000, 40)
    texts += ["=" * k for k in range(150)] + [" " * k for k in range(150)] + ["ab" * 3000, "a" * 5000]
    want = [len(e.ids) for e in known.encode_batch(texts, add_special_tokens=False)]
    assert own.count_all(texts) == want


def test_token_counts_of_awkward_rows(library, table):
    definition, known = library
    docs = table(AWKWARD, "token_count")
    rows = tokens.with_token_counts(docs, definition).collect()
    for r in rows:
        text = r["text"] or ""
        want = len(known.encode(text, add_special_tokens=False).ids)
        assert r["token_count_"].n_tokens == want
        assert r["token_count_"].n_bytes == len(text.encode())
    assert tokens.with_token_counts(docs.limit(0), definition).count() == 0


# --- pieces --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("public_tokenizers")
    return pieces.Model(piece_model())


def test_pieces_are_lossless_and_repeatable(model):
    import numpy as np

    texts = fuzz([" ", "▁", "a", "the", "\n", "é", "日", "🙂", "\x00", "  ", "<s>", "zq"], 3000, 30)
    texts += ["", "x" * 3000, " " * 777]
    keys = np.arange(len(texts), dtype=np.int64)
    out = model.encode_all(texts, keys)
    assert all(model.decode(o.tolist()) == t for o, t in zip(out, texts))
    again = model.encode_all(texts[10:20], keys[10:20])
    assert all((a == b).all() for a, b in zip(again, out[10:20]))


def test_pieces_are_drawn_by_their_weights(model):
    import numpy as np

    def paths(s):
        if not s:
            yield (), 1.0
        for j in range(1, len(s) + 1):
            if s[:j] in model.piece:
                i, w = model.piece[s[:j]]
                for rest, p in paths(s[j:]):
                    yield (i, *rest), w * p

    weights = dict(paths(" thes"))
    total, n = sum(weights.values()), 100_000
    drawn = model.encode_all([" thes"] * n, np.arange(n, dtype=np.int64))
    seen = Counter(tuple(d.tolist()) for d in drawn)
    assert all(abs(seen[p] / n - w / total) < 0.006 for p, w in weights.items())


def test_pieces_of_awkward_rows(table):
    pytest.importorskip("public_tokenizers")
    docs = table(AWKWARD, "pieces")
    content = piece_model()
    out = pieces.with_pieces(docs, content, pieces.row_key(1, F.col("doc_id")))
    back = pieces.with_decoded(out.select("*", F.col("pieces_.ids").alias("ids")), content, "ids")
    for r in back.collect():
        assert r["pieces_"].lossless and r["decoded"] == (r["text"] or "")
    assert pieces.with_pieces(docs.limit(0), content, F.lit(1).cast("bigint")).count() == 0


# --- decontamination -----------------------------------------------------------------------


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_within_the_budget_are_found_exactly():
    rnd = random.Random(5)
    syllables = "tion er and the in of re st ha ou ed ly".split()
    prose = lambda n: "".join(rnd.choice(syllables) + rnd.choice(["", " "]) for _ in range(n))
    items = [(i, prose(rnd.randint(25, 60)).strip()) for i in range(12)]
    block = decontam.Block(items)
    found = 0
    for _ in range(60):
        k, item = rnd.choice(items)
        s = list(item)
        for _ in range(rnd.randint(0, int(len(s) * 0.09))):
            p, o = rnd.randrange(len(s)), rnd.random()
            s[p : p + (o < 0.7)] = rnd.choice("abz") if o < 0.4 or o > 0.7 else ""
        text = prose(10) + " " + "".join(s) + " " + prose(8)
        fold = lambda t: " ".join(t.lower().split(" "))
        best = edits(" ".join(item.lower().split()), " ".join(fold(text).split()))
        got = [m for m in block.matches(text) if m[0] == k]
        assert bool(got) == (best <= int(block.budget[k]))
        if got:
            found += 1
            assert got[0][3] == best
    assert found > 20


def test_leaks_in_tables(spark, table):
    item = "Which of the seven rivers named here runs north into the frozen sea in winter?"
    bench = spark.createDataFrame([(7, item), (8, None), (9, " "), (None, "abc"), (10, "Ab C")], "item_id bigint, text string")
    docs = table([*AWKWARD, (20, "Well: " + item.upper()), (21, "xx ab\n c yab c"), (22, "clean")], "leaks")
    out = decontam.with_leaks(docs, bench)
    got = {r["doc_id"]: [tuple(m) for m in r["leaks_"]] for r in out.collect() if r["leaks_"]}
    assert got == {20: [(7, 6, 6 + len(item), 0)], 21: [(10, 3, 8, 0)]}
    small = decontam.with_leaks(docs, bench, most=10)
    assert {r["doc_id"] for r in small.collect() if r["leaks_"]} == {20, 21}
    kept = decontam.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontam.drop_leaked(docs, bench.limit(0)).count() == docs.count()
    assert decontam.drop_leaked(docs.limit(0), bench).count() == 0


# --- pages ---------------------------------------------------------------------------------

LABELLED = (
    "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy it now</div>"
    "<article><h1>{0}</h1><p>{1}<br><p>{2}</p></article><footer>&copy; site</footer></body></html>"
)
HIDDEN = (
    "<body><div class='site-header'>Site</div><div id=menu><a href=x>Home</a> <a>About</a></div>"
    "<div id=content><h2>Title</h2><p>First &amp; long enough paragraph of the page,<br>on two "
    "lines.</p><p>Ok.</p><script>var t='</p>'</script><ul><li>one</li></ul></div>"
    "<section class=comments><p>I disagree with all of this, dear author.</p></section>"
    "<aside>Other stories that are long enough to be text</aside><!-- end"
)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghi") for _ in range(5)) for _ in range(n))


def test_main_text_of_labelled_and_other_pages(spark):
    rnd = random.Random(2)
    parts = [(words(rnd, 5), words(rnd, 40), words(rnd, 12)) for _ in range(120)]
    rows = [(i, LABELLED.format(*p)) for i, p in enumerate(parts[:100])]
    model = html_text.train(spark.createDataFrame(rows, "page_id bigint, html string"))
    held = sum(html_text.main_text(LABELLED.format(*p), model) == "\n".join(p) for p in parts[100:])
    assert held == 20
    want = "Title\nFirst & long enough paragraph of the page, on two lines.\nOk.\none"
    assert html_text.main_text(HIDDEN, model) == want


def test_words_about_other_elements_do_not_bar_an_article():
    model = html_text.fit({})
    want = "A title of the page\n" + "Text of the article that is long enough to be read. " * 3
    body = "<h1>A title of the page</h1><p>" + want.partition("\n")[2] + "</p></div></body>"
    for name in ("content no-sidebar", "post has-sidebar", "has-sidebar post", "sidebar content", "content with-ads"):
        assert html_text.main_text(f"<body><div class='{name}'>{body}", model) == want.strip()
    for name in ("article-header", "entry-header"):
        page = f"<body><div class=content><div class='{name}'>{body}"
        assert html_text.main_text(page, model) == want.strip()
    for name in ("site-header", "main-menu", "post-comments", "sidebar-content", "sidebar", "screen-reader-text"):
        assert html_text.main_text(f"<body><div class='{name}'>{body}", model) == ""


def test_marginals_equal_enumeration():
    from itertools import product

    import numpy as np

    page = "<body><div><p>some words here</p><li>x</li></div><nav>n<p>q</p></nav><p>more</p>"
    tree, model = html_text.parse(page), html_text.fit({})
    total, yes = 0.0, np.zeros(len(tree.parent))
    for labels in product((0, 1), repeat=len(tree.parent)):
        if any(y and b for y, b in zip(labels, tree.barred)):
            continue
        log = sum(
            model.of[f][labels[n]] for n in range(len(labels)) if not tree.barred[n] for f in tree.features(n)
        )
        for n in range(1, len(labels)):
            if not tree.barred[tree.parent[n]]:
                # An observed node explains nothing under either label of its parent alike.
                log += model.edge[labels[tree.parent[n]] if not tree.barred[n] else 0][labels[n]]
        p = np.exp(log)
        total += p
        yes += p * np.array(labels)
    assert np.allclose(html_text.marginals(tree, model), yes / total)


def test_broken_pages(spark):
    model = html_text.fit({})
    for page in (None, "", "<p", "a<b c", "<!-- x", "<script>x", '<a href="x', "</p></p>", "<" * 5000):
        html_text.main_text(page, model)
    html_text.main_text("<div>" * 20_000 + "deep", model)
    df = spark.createDataFrame([(1, None, "m"), (2, "", "m")], "page_id bigint, html string, main_text string")
    out = html_text.with_main_text(df, model)
    assert out.columns == [*df.columns, "main_text_"] and [r["main_text_"] for r in out.collect()] == ["", ""]
    assert html_text.train(df.limit(0)) == model


# --- queries -------------------------------------------------------------------------------


def test_digest_columns(spark, tmp_path):
    text = "a@b.co 1.2.3.4 token = abcdefgh1"
    spark.createDataFrame([(3, text), (4, None)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    row = {r["doc_id"]: r for r in QUERIES["op6_pii"](spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row[3]["base_sha256"] == digest("email:0:6,ip:7:14") and row[3]["n_ip"] == 1
    assert row[4]["base_sha256"] == digest("") and row[4]["spans"] == ""
    row = {r["doc_id"]: r for r in QUERIES["op3_secret_scan"](spark, str(tmp_path)).collect()}
    assert row[3]["base_sha256"] == digest("assign:15:32") and row[3]["n_assign"] == 1


def test_pieces_do_not_depend_on_what_was_kept_or_forgotten(monkeypatch):
    import random

    import numpy as np

    from quantframe.llm import pieces
    from quantframe.llm.queries_text import piece_model

    rnd = random.Random(5)
    words = ["the", "日本語", "ab🙂", "Straße", "x" * 40, "🙂🙃", "▁", "a\tb"]
    texts = [
        " ".join(rnd.choice(words) + str(rnd.randint(0, 30)) * rnd.randint(0, 2) for _ in range(40)) for _ in range(60)
    ]
    keys = np.arange(len(texts), dtype=np.int64)
    whole = pieces.Model(piece_model())
    want = [i.tolist() for i in whole.encode_all(texts, keys)]
    monkeypatch.setattr(pieces, "MOST_EDGES", 1500)
    tight, kept = pieces.Model(piece_model()), []
    for k in range(len(texts)):
        before = len(tight.ends)
        got = tight.encode_all(texts[k : k + 1], keys[k : k + 1])[0].tolist()
        kept.append(len(tight.ends) < before)
        assert got == want[k] and tight.decode(got) == texts[k]
    assert any(kept) and tight.ends
