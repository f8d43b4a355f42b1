"""The corpus operators against brute force, SQL, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import html
import importlib
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
from pyspark.sql import functions as F

from quillcast.llm import decontaminate, html_text, language, mixing, near_dedup, pii, quality, range_coder, registry, secrets, sharding, token_files

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (None, "one two three four five", "en", "s", 23),
    (None, None, "de", "s", None), (6, "a " * 30000, "en", "s", 60000), (7, "éè \U0001f600 +1 (555) 123-4567 x@y.zz", "fr", "t", 30), (8, "no\x1fbreak space", "en", "t", 14),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def write(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    fix = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(v)
    got = sorted(tuple(fix(r[n]) for n in names) for r in df.collect())
    cursor = c.execute(registry.ORACLE[name])
    cols = [d[0] for d in cursor.description]
    assert sorted(cols) == names
    assert got == sorted(tuple(fix(r[cols.index(n)]) for n in names) for r in cursor.fetchall())


#: Queries whose rows are not documents; their odd rows have tests of their own.
OTHER_ROWS = {"op3_html_text", "quality_ablation", "op13_ranked_search"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - OTHER_ROWS))
def test_odd_rows_and_an_empty_table(spark, odd, tmp_path, name):
    """Every row comes back, whatever is in it; an empty table gives an empty result; clashing columns do no harm."""
    clash = odd.withColumns({"n_words": F.lit("x"), "size": F.lit("x"), "spans": F.lit("x"), "rid": F.lit("x"), "node": F.lit("x"), "start": F.lit("x"), "kept": F.lit("x"), "target": F.lit("x")})
    bench = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, ""), (None, "zzz"), (1, "one two three four five")], "item_id long, text string")
    d = write(clash, tmp_path / "odd")
    write(bench, d, "benchmark")
    assert registry.QUERIES[name](spark, d).count() == len(ODD)
    e = write(odd.limit(0), tmp_path / "empty")
    write(bench.limit(0), e, "benchmark")
    assert registry.QUERIES[name](spark, e).count() == 0


def test_ablation_of_odd_rows_and_of_an_empty_table(spark, odd, tmp_path):
    """A row for each policy and rule, whatever the documents are; without documents all counts are 0."""
    d, e = write(odd.withColumns({"rule": F.lit("x"), "policy": F.lit("x")}), tmp_path / "odd"), write(odd.limit(0), tmp_path / "empty")
    got, none = registry.QUERIES["quality_ablation"](spark, d).collect(), registry.QUERIES["quality_ablation"](spark, e).collect()
    rules = {(p, r) for p, own in quality.POLICIES.items() for r in own}
    assert len(got) == len(rules) and {(r.policy, r.rule) for r in got} == {(r.policy, r.rule) for r in none} == rules
    assert all((r.n_failed, r.n_only, r.n_kept_without) == (0, 0, 0) for r in none)
    failed = {(r.policy, r.rule): r.n_failed for r in got}
    assert max(failed.values()) >= 8 and all(0 <= r.n_only <= r.n_failed <= len(ODD) for r in got)


# 1. mixing


def test_mix_meets_its_targets(spark, docs, tmp_path):
    got = mixing.op1_mix_sources(spark, DATA).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = Counter()
    for r in got:
        by[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    words = sum(r["size"] for r in got)
    block = words / 2 ** math.ceil(math.log2(words) * 2 / 3) + 1
    assert all(abs(by[r.source] - r.target) <= block for r in got)
    again = mixing.op1_mix_sources(spark, DATA)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in got)


def python_mix(rows, weights=(1, 2, 3), epochs=3):
    """The mix of rows (doc_id, source, size) with different ids, by the definition: {doc_id: (taken, first slot, slots)}."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        for s in over or open_:
            target[s] = epochs * float(sizes[s]) if over else level * w[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    whole = {s: min(round(target[s]), epochs * sizes[s]) for s in names}
    total = sum(whole.values())
    bits = max(1, math.ceil(math.log2(max(total, 1)) * 2 / 3))
    begin = lambda k: k * total >> bits
    slots = {s: [] for s in names}
    for n in range(2**bits):
        point, upto = int(f"{n:0{bits}b}"[::-1], 2), 0
        for s in names:
            upto += whole[s]
            if point * total < upto << bits:
                slots[s].append(n)
                break
    out = {d: [0, None, set()] for d, _, _ in rows}
    for s in names:
        stream = sorted((hashlib.md5(f"{d}mix".encode()).hexdigest(), d, n) for d, source, n in rows if source == s)
        words = [d for _ in range(epochs) for _, d, n in stream for _ in range(n)]
        for k, slot in enumerate(slots[s]):
            for d in words[begin(k) : begin(k + 1)]:
                out[d][0] += 1
                out[d][2].add(slot)
    return {d: (n, min(x) if x else None, len(x)) for d, (n, _, x) in out.items()}, target


def test_mix_by_a_python_schedule(spark, docs, tmp_path):
    rng = random.Random(3)
    tables = [[(k, rng.choice(["a", "b", None, "d", "é"]), rng.choice([0, 1, 7, 30, 400])) for k in range(120)], [(k, "ab"[k > 0], 5 if k else 2) for k in range(9)], [(1, "x", 1)], [(1, None, 0)]]
    for k, rows in enumerate(tables):
        df = spark.createDataFrame([(d, s, "w " * n) for d, s, n in rows], "doc_id long, source string, text string")
        got = mixing.op1_mix_sources(spark, write(df, tmp_path / str(k))).collect()
        want, target = python_mix(rows)
        assert {r.doc_id: (r.taken, r.first_slot, r.n_slots) for r in got} == want
        source = {d: s for d, s, _ in rows}
        assert all(r.target == pytest.approx(target[source[r.doc_id]]) for r in got if sum(n for _, _, n in rows))


def test_schedule_is_even_everywhere(spark):
    sized = spark.createDataFrame([(k, k, "ab"[k % 2] if k % 10 else None, 1000) for k in range(300)], "rid long, doc_id long, source string, size long")
    targets = mixing.source_targets(sized).cache()
    slots = sorted((r.slot, r.sid) for r in mixing.schedule(targets).collect())
    rows = targets.collect()
    assert [s for s, _ in slots] == list(range(2 ** rows[0].bits))
    half = Counter(s for _, s in slots[: len(slots) // 2])
    assert all(abs(half[r.sid] - r.slots / 2) <= 2 for r in rows)
    ranks = {}
    for r in sorted(mixing.schedule(targets).collect(), key=lambda r: r.slot):
        assert r.k == ranks.get(r.sid, -1) + 1
        ranks[r.sid] = r.k


def test_mixed_documents_are_in_the_order_of_the_schedule(spark, docs):
    mixed = mixing.mixed_documents(docs.withColumns({"rid": F.lit("x"), "slot": F.lit("y"), "k": F.lit("z")}))
    got = [(r.doc_id, r.rid, r.slot, r.k) for r in mixed.collect()]
    first = {r.doc_id: (r.first_slot, r.taken, r["size"]) for r in mixing.op1_mix_sources(spark, DATA).collect()}
    assert {x[1:] for x in got} == {("x", "y", "z")}
    seen = [first[d][0] for k, (d, *_) in enumerate(got) if d not in {x[0] for x in got[:k]}]
    assert seen == sorted(seen)
    assert all(abs(n * first[d][2] - first[d][1]) <= first[d][2] for d, n in Counter(x[0] for x in got).items())


def test_excess_of_capped_sources_goes_to_the_others(spark):
    sized = spark.createDataFrame([(0, 0, "a", 1000), (1, 1, "b", 10), (2, 2, "c", 20), (3, 3, None, 0)], "rid long, doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got == {"a": pytest.approx(1030 - 30 - 60), "b": 30, "c": 60, None: 0}


# 2. secrets


def test_trigram_queries():
    q = {n: secrets.trigram_query(p) for n, p, _ in secrets.RULES}
    assert q["hex"] is None and q["access"] == [{"aki", "kia"}]
    assert {"pas", "ass", "ssw", "swo", "wor", "ord"} in q["assign"] and {"api", "pik", "ike", "key"} in q["assign"] and {"api", "pi_", "i_k", "_ke", "key"} in q["assign"]


def brute_secrets(text):
    out = []
    for k, (name, pattern, check) in enumerate([
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if check(m)]
    return ",".join(x for _, _, x in sorted(out))


def test_secrets_by_brute_force(spark, rows, tmp_path):
    rng = random.Random(5)
    parts = ["password", "PassWd", "Secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é", "\n", "x", "ghp_" + "a1" * 18]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + [r.text for r in rows]
    d = write(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), tmp_path)
    for r in secrets.op2_secret_scan(spark, d).collect():
        want = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert any("hub_token" in r.spans for r in secrets.op2_secret_scan(spark, d).collect())


# 3. main text


def test_main_text():
    rows = html_text.labelled_rows()
    tree = html_text.grow(rows)
    assert (html_text.decide(tree, rows[:, :-1]) == rows[:, -1]).mean() > 0.97
    page = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies and you accept all of them by reading on</div><article><h1>A  title</h1><p><b>First &amp; foremost<br>text.<p>Second one.</p>
    <script>var x = "</p>";</script><!-- a <p>comment</p> --><aside>Aside text that is as long as a paragraph might be here</aside><form>Your name <input></form></article>
    <section id="comments"><p>Nice article, thank you so much for writing it for all of us!</p></section><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page, tree) == "A title\n\nFirst & foremost text.\n\nSecond one."
    page = """<body class="single has-sidebar"><div class="with-sidebar"><article class="post"><div class="entry-header"><h1>Title</h1></div><p>Text.</p><p hidden>Not shown at all.</p>
    <div class="share-links">Share this page</div></article></div><div id="sidebar"><p>Some long text in the side bar of this page that is no content.</p></div></body>"""
    assert html_text.main_text(page, tree) == "Title\n\nText."
    assert html_text.main_text("", tree) == "" and html_text.main_text("<p", tree) == ""


def test_names_do_not_hide_the_main_text():
    tree = html_text.grow(html_text.labelled_rows())
    long = "word " * 40 + "end."
    both, one = f"{long}\n\n{long}", f"<p>{long}</p>"
    text = lambda page: html_text.main_text(page, tree)
    # A small block with a name like that of content.
    assert text(f'<div id="page"><h1 class="article-title">T</h1>{one}{one}</div>') == f"T\n\n{both}"
    assert text(f'<div class="main-image">Caption</div><p class="post-date">May 3</p>{one}{one}').endswith(both)
    assert text(f"<article><p>Small.</p></article>{one}{one}").endswith(both)
    # Wrappers with names of surroundings.
    for page in (f"<form><main>{one}{one}</main></form>", f"<form>{one}{one}</form>", f'<div class="layout sidebar-right"><article>{one}{one}</article></div>', f'<div class="content two-col sidebar-left">{one}{one}</div>', f'<div class="promo"><main>{one}{one}</main></div>'):
        assert text(page) == both, page
    assert text(f'<article>{one}</article><div hidden><main>{one}{one}</main></div><section id="comments"><article class="comment">{one}{one}{one}</article></section>') == long
    # A very long block beside named content, and one in surroundings.
    far = "word " * 300 + "end."
    assert text(f"<article>{one * 9}</article><p>{far}</p>").endswith(far) and far not in text(f"<article>{one * 9}</article><footer>{far}</footer>")
    # A head, and elements, without an end tag.
    for page in (f'<head><title>t</title><script>"<p>"</script>{one}{one}', f"<head><meta x><main>{one}{one}</main>", f"<svg><path>{one}{one}<svg><text>no</text></svg>", f"<article><object>{one}{one}</article><object>no</object>", f"<button><article>{one}{one}</article><button>no</button>"):
        assert text(page) == both, page


def test_words_and_links_decide_where_names_do_not():
    tree = html_text.grow(html_text.labelled_rows())
    long = "word " * 40 + "end."
    one, both = f"<p>{long}</p>", f"{long}\n\n{long}"
    links = "<ul><li><a href=a>Home</a></li><li><a href=b>News of today</a></li><li><a href=c>About us</a></li></ul>"
    for page, want in [
        (f'<article><h2>A</h2>{one}<p class="author-analysis">{long}</p><p class="form-of-government">{long}</p></article>', f"A\n\n{both}\n\n{long}"),
        (f'<article>{one}{one}</article><ol class="commentlist"><li>{long}</li><li>{long}</li></ol>', both),
        (f"<div>{one}{one}<p>A short last one.</p></div>", f"{both}\n\nA short last one."),
        (f"<article>{one}<ul><li><a href=x>First paper</a></li><li><a href=y>Second paper of it</a></li></ul>{one}</article>", f"{long}\n\nFirst paper\n\nSecond paper of it\n\n{long}"),
        (f'<div class="entry-header"><h1>The title here</h1></div><article>{one}{one}</article>', f"The title here\n\n{both}"),
        (f"{links}<h1>Title of it</h1>{one}{one}{one}{links}", f"Title of it\n\n{both}\n\n{long}"),
        (f'<div id="sidebar"><p>{long}</p></div><article>{one}{one}</article>', both),
        (f'<div class="post"><div class="post-body">{one}{one}<div class="share-links">Share this</div></div><div class="post-comments">{one}{one}{one}</div></div>', both),
        (f'<main><article>{one}{one}<div class="authorBox">Jane Roe writes about things.</div></article><aside>{one}</aside></main>', both),
        (links, ""),
    ]:
        assert html_text.main_text(page, tree) == want, page.replace(long, "L")


def test_the_core_decides_where_no_name_does():
    tree = html_text.grow(html_text.labelled_rows())
    line = lambda n: "word " * (n - 1) + "end."
    notice, rights = "We use cookies to improve your visit. Accept them all.", "Copyright 2020 Some Company. All rights reserved."
    for n in (12, 40, 90):
        want = ["A fine title", line(n), line(n + 9), line(n // 2)]
        body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{w}</p>" for w in want[1:])
        talk = "".join(f"<div>{who}: {line(k)}</div>" for who, k in (("Ann", 30), ("Bob", 20), ("Cid", 40)))
        for page in (f'<div class="cc-window">{notice}</div><main>{body}</main>', f"<main>{body}</main><div>{rights}</div>", f'<div class="q"><div class="z">{body}</div></div><div>{rights}</div>'):
            assert html_text.main_text(page, tree).split("\n\n") == want, page
        for page in (f'<main>{body}</main><div class="user-feedback">{talk}</div>', f'<div class="z">{body}</div><div class="q">{talk}</div>'):
            got = html_text.main_text(page, tree).split("\n\n")
            assert got[:4] == want and (len(got) == 4 or n == 12), page  # comments that are longer than the text and have no name stay
    # What a page repeats is no core, and a short text before long comments stays.
    parts = "".join(f"<section><h2>Part</h2><p>{line(k)}</p><p>{line(9)}</p></section>" for k in (300, 40, 30))
    assert html_text.main_text(f"<div>{parts}</div>", tree).count("Part") == 3
    for sort in ("p", 'div class="para"'):
        got = html_text.main_text("<div>" + "".join(f"<{sort}>{line(k)}</{sort.split()[0]}>" for k in (200, 9, 12)) + "</div>", tree)
        assert len(got.split("\n\n")) == 3


def test_blocks_of_pages_without_names(spark):
    """The pages with every part written as a div without a name: what was in the article is found by the shape of the page."""
    tree = html_text.grow(html_text.labelled_rows())
    kept = right = wanted = 0
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        facts, plain = html_text.text_blocks(p.html)[1], re.sub('<div class="ad">', "<div>", re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|ul)\b[^>]*>", r"<\1div>", p.html))
        inside = np.array([f[3] == 1 for f in facts])
        found = html_text.decide(tree, html_text.features(*html_text.text_blocks(plain)[1:]))
        kept, right, wanted = kept + found.sum(), right + (found & inside).sum(), wanted + inside.sum()
    assert right == wanted and right / kept > 0.95


def test_end_tags_of_nothing_are_passed_over_in_linear_time():
    began = time.process_time()
    deep = "<div>" * 20000 + "</p></section>" * 50000 + "<p>One sentence of text.</p>" + "</div>" * 20000
    texts, facts, _, _ = html_text.text_blocks(deep)
    assert texts == ["One sentence of text."] and facts[0][0] == 4 and time.process_time() - began < 10
    texts = html_text.text_blocks("<div><section><p>a</section>b</p></div></section>c</div>")[0]
    assert texts == ["a", "b", "c"]


def test_pages_odd_rows(spark, tmp_path):
    pages = [(1, "u", "<article><p>Some text.</p></article>", "x", "y"), (1, "u", "<article><p>Some text.</p></article>", "x", "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars string")
    got = html_text.op3_html_text(spark, write(df, tmp_path / "a", "pages"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "Some text.", 10), (1, "Some text.", 10)]
    assert html_text.op3_html_text(spark, write(df.limit(0), tmp_path / "b", "pages")).count() == 0


def test_main_text_of_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.op3_html_text(spark, DATA).collect()}
    for p in pages:
        inside = html.unescape(re.sub("<[^>]*>", " ", re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]))
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
        for block in got[p.page_id].text.split("\n\n"):
            assert block.split()[0].strip(".,") in inside
        assert len(got[p.page_id].text.split()) == len(inside.split())
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 50000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.op3_html_text(spark, write(odd, tmp_path, "pages")).collect()) == [0, 0, 249999]


# 4. language


def test_language_on_held_out_documents(spark, docs):
    got = language.op4_identify_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_sampled_texts_are_bounded(spark):
    """A longer text gives pieces from all over it; others stay as they are, and predictions still read whole texts."""
    numbers = " ".join(f"n{k}" for k in range(20000))
    rows = spark.createDataFrame([(1, numbers, "en"), (3, "short text", "en"), (4, "x" * language.LONGEST, "de")], "doc_id long, text string, lang string")
    got = dict(rows.select("doc_id", language.excerpt(F.col("text")).alias("t")).collect())
    assert got[3] == "short text" and got[4] == "x" * language.LONGEST
    assert len(got[1]) == language.LONGEST - 1 and got[1].startswith(numbers[:500]) and got[1].endswith(numbers[-500:])
    places = [numbers.index(piece[6:40]) for piece in (got[1][k * 1024 : k * 1024 + 1023] for k in range(16))]
    assert places == sorted(places) and max(np.diff(places)) < len(numbers) / 14
    assert sorted(len(r["text"]) for r in language.sample(rows)) == sorted(len(got[r["doc_id"]]) for r in rows.filter((language.fold() != 1)).collect())


def test_language_rejects_what_has_no_letter(spark):
    model = language.train(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    df = spark.createDataFrame([(1, None), (2, "123 !?"), (3, "the dog and the cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(df, model, "doc_id").collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("und", "und", "en") and got[1].rejected and got[1].score == 0


# 5. quality


def test_ledger_and_ablation(spark):
    texts = {"clean": " ".join(f"word{k}" for k in range(40)), "short": "few words", "junk": " ".join(f"word{k}***" for k in range(40)), "loud": " ".join(f"WORD{k}!!" for k in range(40))}
    found = quality.ledger(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).cache()
    kept = {r.doc_id for r in found.filter(quality.verdict("v1")).collect()}
    assert kept == {"clean"}
    ab = {r.rule: r for r in quality.ablation(found).collect()}
    assert ab["few_words"].n_only == 1 and ab["few_words"].n_kept_without == 2 and ab["symbols"].n_failed == 1
    assert {r.n_failed for r in quality.ablation(found.limit(0)).collect()} == {0}


def test_quality_of_labelled_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    good = quality.op5_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("NOT base_failed").cache()
    assert good.filter("kept").count() / good.count() > 0.98


def test_longest_run_of_short_texts(spark):
    texts = [(1, "one three  eleven\tx"), (2, ""), (3, None), (4, " \n"), (5, "y" * 1000), (6, "a " * 600 + "four")]
    got = {r.doc_id: r.longest_run for r in quality.ledger(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 6, 2: 0, 3: 0, 4: 0, 5: 1000, 6: 4}


# 6. personal data


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(k, f"write to contact: user{k}@mail.example and nothing else here") for k in range(12)]
    new = [(100 + k, f"as before contact: AB-{k:06d} is what we have") for k in range(3)]
    other = [(200 + k, f"the year was {k:06d} or so") for k in range(5)]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(seeds + new + other, "doc_id long, text string")).collect()}
    assert all(len(got[k].context) == 1 for k, _ in new) and all(not got[k].context for k, _ in other + seeds)
    assert all(len(got[k].base.email) == 1 for k, _ in seeds)


def test_contexts_reach_a_second_generation(spark):
    seeds = [(k, f"write to contact: user{k}@mail.example and nothing else here") for k in range(30)]
    both = [(100 + k, f"as before contact: AB-{k:06d} is what we have") for k in range(6)] + [(200 + k, f"please show badge AB-{k:06d} at the door") for k in range(6)]
    further = [(300, "please show badge AB-777777 at the door")]
    other = [(400 + k, f"the year was {k:06d} or so") for k in range(9)]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(seeds + both + further + other, "doc_id long, text string")).collect()}
    assert all(len(got[k].context) == 1 for k, _ in both + further) and all(not got[k].context for k, _ in other)


def python_bootstrap(texts):
    """The context spans of texts of single blanks, whose seeds are e-mail addresses: by the definition in pii.py."""
    word = lambda w, k: w[k] if 0 <= k < len(w) else None
    form = lambda t: re.sub("[^\\W\\dA_]+", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))

    def patterns(w, k, near):
        """near: an instance's words on either side that are its own gap's."""
        l1, l2, r = (w[k - 1].lower() if near[0] >= 1 else None), (w[k - 2].lower() if near[0] >= 2 else None), (w[k + 1].lower() if near[1] >= 1 else None)
        return [p for p in ((1, l1), (2, l2, l1), (3, l1, r), (4, l1, form(w[k]))) if None not in p]

    seeds, edges, counts, places = set(), Counter(), Counter(), []
    for d, text in enumerate(texts):
        w = text.split(" ")
        is_seed = [re.fullmatch(r"[a-z0-9]+@[a-z]+\.[a-z]+", x) is not None for x in w]
        is_token = [not s and re.search("[0-9]", x) is not None for s, x in zip(is_seed, w)]
        for kind in (is_seed, [re.search("[0-9]", x) is not None for x in w]):
            at = [-1, *(k for k, y in enumerate(kind) if y), len(w)]
            for a, k, b in zip(at, at[1:-1], at[2:]):
                if kind is not is_seed and not (is_token[k] and len(w[k]) >= pii.LENGTH and sum(c.isdigit() for c in w[k]) >= pii.DIGITS):
                    continue
                ps = patterns(w, k, (k - a - 1, b - k - 1))
                if kind is is_seed:
                    seeds.add(w[k])
                else:
                    places.append((d, len(" ".join(w[:k])) + (k > 0), len(w[k]), ps))
                for p in ps:
                    edges[p, w[k]] += 1
        for k in range(1, len(w)):
            low = [x.lower() for x in w]
            for p in ((1, low[k - 1]), (2, word(low, k - 2) if k > 1 else None, low[k - 1]), (3, low[k - 1], word(low, k + 1))):
                counts[p] += 1
    own, different = Counter(), Counter()
    for (p, _), n in edges.items():
        own[p] += n
        different[p] += 1
    wanted = {p for p, n in different.items() if n >= pii.SEEDS}
    total = {p: max(own[p], counts[p]) for p in wanted if p[0] < 4}
    for p in wanted:
        if p[0] == 4 and not own[1, p[1]] < pii.RATE * total[1, p[1]]:
            total[p] = own[p]
    accepted, good = set(seeds), None
    while True:
        right, n_right = Counter(), Counter()
        for (p, v), n in edges.items():
            if p in total and v in accepted:
                right[p] += n
                n_right[p] += 1
        now = {p for p in total if right[p] / (total[p] + 2) >= pii.CONFIDENCE and n_right[p] >= pii.SEEDS}
        if now == good:
            return {(d, s, s + n) for d, s, n, ps in places if now & set(ps)}
        good = now
        accepted |= {v for p, v in edges if p in good}


def test_contexts_by_brute_force(spark):
    rng = random.Random(12)
    names = [f"u{k}@mail.org" for k in range(25)]
    codes = [f"AB-{k:05d}" for k in range(30)] + [f"{k}77001" for k in range(10, 30)]
    plain = ["the", "of", "and", "house", "River", "was", "2019", "old", "blue", "42"]

    def clause():
        kind = rng.random()
        if kind < 0.25:
            return ["contact:", rng.choice(names)] if rng.random() < 0.7 else ["contact:", rng.choice(codes)]
        if kind < 0.4:
            return ["badge", rng.choice(codes), "ok"]
        if kind < 0.5:
            return ["the", rng.choice(codes + names)]
        return [rng.choice(plain) for _ in range(rng.randrange(1, 7))]

    texts = [" ".join(x for _ in range(rng.randrange(1, 12)) for x in clause()) for _ in range(200)]
    found = pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r.doc_id, x.s, x.e) for r in found for x in r.context}
    assert got == python_bootstrap(texts) and got


def test_contexts_in_prose(spark, docs):
    """Real-like prose with planted account numbers: nearly all are found, little else, and no stop word is trusted."""
    rng = random.Random(6)
    texts = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 30][:150]
    planted, rows = {}, []
    for k, t in enumerate(texts):
        w = t.split()[:300]
        what = f"user{k}@mail.org" if k % 3 else f"K{rng.randrange(10**7):07d}"
        at = rng.randrange(5, len(w) - 5)
        w[at:at] = ["customer", "id:", what] if k % 2 else ["reach", "me:", what, "thanks"]
        w.insert(rng.randrange(len(w)), str(rng.randrange(10**6, 10**7)))  # a number that is nobody's
        if not k % 3:
            planted[k] = what
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {(r.doc_id, text[r.doc_id][x.s : x.e]) for r in pii.find_personal(df).collect() for x in r.context}
    right = {(k, v) for k, v in planted.items()}
    assert len(got & right) >= 0.9 * len(right) and len(got & right) >= 0.9 * len(got)
    trusted = {r.p for r in pii.trusted_patterns(df.select("text"), pii.find_entities(df)).collect()}
    assert trusted and all(set(p.split()[1:]) & {"id:", "me:"} for p in trusted)


def test_personal_data_by_brute_force(spark, tmp_path):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, t):
        d = re.sub("[^0-9]", "", t)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in t.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    rng = random.Random(9)
    parts = ["a", "b.c", "@", ".", "x-y", "_", "1", "25", "255", "300", "4111 1111 1111 1111", "0", "+1", "(", ")", " ", "-", "é", "\n", "4041894974608795", "10.0.0.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)] + ["1" * 5000, "a" * 20000 + "@b.cc"]
    d = write(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), tmp_path)
    for r in pii.op6_find_personal_data(spark, d).collect():
        spans = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id]) if good(n, m[0]))
        assert r.base_sha256 == hashlib.sha256(",".join(x for _, _, x in spans).encode()).hexdigest(), texts[r.doc_id][:200]


# 7. token files


@pytest.mark.parametrize("sizes", [[0], [1], [1000, 0, 7], [70000]])
def test_range_coder_round_trip(sizes):
    rng = np.random.default_rng(3)
    blocks = [np.where(rng.random(n) < 0.5, rng.integers(0, 50, n), rng.integers(0, 50257, n)) for n in sizes]
    coded = range_coder.encode(blocks, 50257)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, range_coder.decode(coded)))


def test_range_coder_finds_damage_and_saves_space():
    ids = np.tile(np.arange(300), 200)
    data = bytearray(range_coder.encode([ids], 50257)[0])
    assert len(data) < len(ids) / 2
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode([bytes(data)])


def test_encoder_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    source = open(token_files.vocabulary_file()).read()
    whole = tokenizers.Tokenizer.from_str(source)
    rng = random.Random(11)
    parts = ["a", "bc", " ", "  ", "\n", "\t", " \n", "'s", "é", "1", ".", " ", "​", "\x1c", "\x85", "<|endoftext|>", "don't", "日本", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|endoftext|>", "\x00 x foo. bar,! _x_"]
    assert 50256 in whole.encode(texts[-2], add_special_tokens=False).ids
    for kept in (60, token_files.MOST_KEPT):  # with a cache that forgets, too
        encoder = token_files.Encoder(source, kept)
        for k in range(0, len(texts), 250):
            part = texts[k : k + 250]
            ids, sizes = encoder.encode(pa.array(part))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in part]
            assert len(encoder.met) <= max(kept, 4000)


def test_token_files(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(token_files.vocabulary_file())
    got, start = {r.doc_id: r for r in token_files.op7_token_files(spark, DATA).collect()}, 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# 8. sharding


def test_differencing_beats_greedy_and_is_a_partition():
    rng = np.random.default_rng(1)
    sizes = np.zeros((200, 4), np.int64)
    sizes[:, 3] = rng.integers(1, 10_000, 200)
    totals, place = sharding.difference(sizes)
    want = np.zeros(4, np.int64)
    for k in range(200):
        want[place[k, 3]] += sizes[k, 3]
    assert (want == totals).all() and totals.max() - totals.min() < 100


def test_differencing_by_the_definition():
    """Two parts: the largest numbers are replaced by their difference, which is what the spread ends at."""
    rng = random.Random(4)
    for n in (1, 2, 5, 40):
        numbers = [rng.randrange(1, 1000) for _ in range(n)]
        left = sorted(numbers)
        while len(left) > 1:
            a, b = left.pop(), left.pop()
            left = sorted([*left, a - b])
        totals, _ = sharding.difference(np.column_stack([np.zeros(n, np.int64), numbers]))
        assert totals[1] - totals[0] == left[0]


def test_differencing_against_greedy():
    rng = np.random.default_rng(2)
    better = 0
    for _ in range(20):
        sizes = np.zeros((60, 4), np.int64)
        sizes[:, 3] = rng.integers(1, 10_000, 60)
        load = [0] * 4
        for x in sorted(sizes[:, 3].tolist(), reverse=True):
            load[load.index(min(load))] += x
        totals, _ = sharding.difference(sizes)
        better += int(totals.max() - totals.min() < max(load) - min(load))
    assert better >= 18


def test_shards_do_not_depend_on_partitions(spark, docs):
    one = sorted(tuple(r) for r in sharding.shard_documents(docs.select("doc_id", "text").coalesce(1)).collect())
    many = sorted(tuple(r) for r in sharding.shard_documents(docs.select("doc_id", "text").repartition(7, "text")).collect())
    assert one == many


def test_shards(spark, rows):
    got = sharding.op8_shard(spark, DATA).collect()
    text = {r.doc_id: r.text for r in rows}
    shard_of, load, slots = {}, Counter(), {}
    for r in got:
        assert shard_of.setdefault(text[r.doc_id], r.shard) == r.shard
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        load[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())


def test_several_levels(spark):
    items = spark.range(500).selectExpr("id item", "id % 97 + 1 size").cache()
    got = sharding.assign(items, 4, fan=16).join(items, "item").groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 500 and max(r.s for r in got) - min(r.s for r in got) <= 20


# 9. near duplicates


def brute_components(texts, n, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def mutated(seed, copies):
    """A chain-like group: every copy edits the one before or the first, so that a star around any text misses links."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [base]
    for k in range(copies):
        t = list(rng.choice([base, texts[-1], rng.choice(texts)]))
        for _ in range(rng.randrange(1, 7)):
            t[rng.randrange(len(t))] = f"n{seed}_{k}_{rng.randrange(9999)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, rows, n, percent):
    texts = [r.text for r in rows] + mutated(1, 150) + mutated(2, 60) + ["Same", "same", "SAME  ", "a b", "A  B", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, sizes = brute_components(texts, n, percent)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, words=n, percent=percent, bands=20, rows=5, block_bytes=16 * 900).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert [got[k].component_id for k in range(len(texts))] == want
    assert all(got[k].kept == (want[k] == k) for k in range(len(texts)))


def test_one_of_each_group_stays(spark, odd):
    kept = near_dedup.drop_near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in kept)[4] == 1 and {1, 2, 3, 6, 7, 8} <= {r.doc_id for r in kept}


def test_dropping_has_a_defined_tie_and_any_columns(spark):
    rows = [(1, "a b c d e f", k % 3, f"v{k % 4}", {"m": k}) for k in range(12)] + [(2, "a b c d e f", 0, "w", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash string, row map<string, long>")
    for parts in (1, 5):
        got = near_dedup.drop_near_duplicates(df.repartition(parts)).collect()
        assert [(r.doc_id, r._id, r._hash, r.row) for r in got] == [(1, 0, "v0", {"m": 0})]


# 10. decontamination


def test_windows_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 12])))) for k in range(30)]
    items += [(90, " ".join(docs[7][1].split()[3:18])), (91, ", ".join(docs[9][1].upper().split()[:10]))]
    docs.append((60, "clean text, nothing of it anywhere"))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=40)
    for r in found.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", dict(docs)[r.doc_id].lower())
        hit, which, best = set(), set(), 0
        for item, text in items:
            t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            size = min(10, len(t))
            for i in range(len(t) - size + 1):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == t[i : i + size]:
                        hit |= set(range(j, j + size))
                        which.add(str(item))
                        n = size
                        while i + n < len(t) and j + n < len(w) and w[j + n] == t[i + n]:
                            n += 1
                        best = max(best, n)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(which), bool(hit))
        assert (r.longest.words if r.longest else 0) == best


def test_repeated_words_stay_linear(spark):
    items = spark.createDataFrame([("a", "the " * 800), ("b", "of the " * 300), ("c", "the")], "item_id string, text string")
    docs = [(1, "the " * 8000), (2, "of the " * 2000 + "end"), (3, "nothing here"), (4, None)]
    got = {r.doc_id: r for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert (got[1].n_hit, got[1]["items"], got[1].longest.words) == (8000, ["a", "c"], 800)
    assert (got[2].n_hit, got[2]["items"], got[2].longest.words) == (4000, ["b", "c"], 600)
    assert got[3].n_hit == got[4].n_hit == 0 and not got[3].contaminated
    block = decontaminate.make_block(["a"], ["the " * 800], 10)
    hashes = np.full(8000, block["vocabulary"][0])
    assert len(decontaminate.search(hashes, np.array([0]), block)[0]) == 7991


def test_suffix_array_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0)
        after = lambda i: next((w[i:k].tolist() for k in range(i, len(w)) if w[k] == 0), [])  # noqa: E731, B023
        found = [after(i) for i in decontaminate.suffix_array(w).tolist()]
        assert found == sorted(found)


def test_longest_matches_by_brute_force():
    """Test suffixes in a shard's suffix array: every place's longest match and its item, whatever repeats."""
    from quillcast.llm.text_arrays import ALNUM, LOWER, text_buffers, word_bounds, word_hashes

    rng = random.Random(4)
    for trial in range(40):
        few = [f"w{k}" for k in range(rng.choice([1, 2, 3, 30]))]
        some = lambda n: " ".join(rng.choice([*few, "other"] if rng.random() < 0.1 else few) for _ in range(n))  # noqa: E731, B023
        items = [some(rng.choice([1, 3, 9, 10, 11, 25, 60])) for _ in range(rng.choice([1, 4, 12]))]
        texts = [some(rng.randrange(80)) for _ in range(8)] + [some(5) + " " + rng.choice(items) + " " + some(3), rng.choice(items), ""]
        texts += texts[3:6]
        block = decontaminate.make_block([str(k) for k in range(len(items))], items, 10)
        data, offs = text_buffers(pa.array(texts))
        starts, ends, first = word_bounds(LOWER[data], offs, ALNUM)
        which, where, doc, size, item = decontaminate.search(word_hashes(LOWER[data], starts, ends), first[:-1], block)
        want = {}
        for d, w in enumerate(t.split() for t in texts):
            for i in range(len(w)):
                for t in (x.split() for x in items):
                    for j in range(len(t)):
                        n = 0
                        while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                            n += 1
                        if n >= 10:
                            want[first[d] + i] = max(want.get(first[d] + i, 0), n)
        assert {p: n for p, n in zip(where.tolist(), size.tolist()) if n} == want, trial
        for p, d, n, t in zip(where.tolist(), doc.tolist(), size.tolist(), item.tolist()):
            assert first[d] <= p < first[d + 1]
            assert not n or f" {' '.join(texts[d].split()[p - first[d] :][:n])} " in f" {items[t]} "


def test_blocks_of_the_benchmark_give_what_one_gives(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(str(k), some(30)) for k in range(25)] + [("x", some(4)), ("x", some(4)), (None, some(14)), ("e", ""), ("n", None)]
    docs = [(k, some(20) + " " + " ".join(rng.choice(items[:25])[1].split()[: rng.randrange(30)]) + " " + some(9), k % 3) for k in range(50)]
    # Overlapping finds of two items, no text, and a repeated row.
    docs += [(50, items[0][1] + " " + items[1][1], 1), (50, items[0][1] + " " + items[1][1], 1), (51, None, 1), (None, "", 2)]
    items.append(("o", " ".join((items[0][1] + " " + items[1][1]).split()[15:45])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string, _id int"), spark.createDataFrame(items, "item_id string, text string")
    for with_text in (True, False):
        rows = [sorted((repr((r.doc_id, r._id, r.n_words, r.n_hit, r["items"], r.longest and r.longest.words, r.contaminated, with_text and r.text)) for r in decontaminate.find_leaks(d, b, block_words=n, keep_text=with_text).collect())) for n in (1 << 19, 60)]
        assert rows[0] == rows[1] and len(rows[0]) == 54


# The pipeline


def test_pipeline_stage_by_stage(spark, docs):
    pipeline = importlib.import_module("corpus_pipeline")
    assert len(pipeline.STAGES) == 5 and all(callable(f) for _, f in pipeline.STAGES)
    now, seen = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        now = near_dedup.keep(stage(spark, now, DATA), name)
        assert now.columns == docs.columns
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    everything = {r.doc_id: r for r in docs.collect()}
    assert all(b <= a for a, b in zip([set(everything), *seen], seen))
    texts = sorted(seen[0])
    roots, _ = brute_components([everything[k].text for k in texts], 5, 80)
    assert seen[1] == {texts[k] for k, r in enumerate(roots) if r == k}
    tokens = pipeline.STAGES[-1][1](spark, now, DATA)
    assert tokens.count() == now.count()
    assert pipeline.run(spark, DATA).count() == now.count()


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    d = write(odd, tmp_path)
    write(spark.createDataFrame([(1, "a b")], "item_id long, text string"), d, "benchmark")
    for _, stage in pipeline.STAGES:
        stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count()
    assert pipeline.run(spark, d).count() == 0
    # Columns whose names the stages might use themselves, and an empty table.
    names = ["rid", "row", "_id", "_hash", "size", "slot", "items", "kept", "node", "failures", "id", "hash", "n", "key", "_text", "contaminated", "longest"]
    clash = odd.withColumns({c: F.lit(c) for c in names})
    for df in (clash, clash.limit(0)):
        for name, stage in pipeline.STAGES:
            got = stage(spark, df, d)
            if name != "token_files":
                assert got.columns == clash.columns and all(r[c] == c for r in got.collect() for c in names), name
            assert got.count() <= 3 * df.count()
