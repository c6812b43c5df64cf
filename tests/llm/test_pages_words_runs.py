"""Wrappers, spelling variants and periodic runs against brute force and hand-made cases."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import extraction, runs, spelling
from quillmark.llm import wrappers as W
from quillmark.llm.recompression import Grammar

from .conftest import prose

SPLIT = re.compile("[^\x20\x09-\x0D]+")


# --- pages ---------------------------------------------------------------------------------------

def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{body}</body></html>"


def wrapper_of(*pages):
    out = W.inferred(W.parse(pages[0]))
    for p in pages[1:]:
        out = W.merged(out, W.inferred(W.parse(p)))
    return out


def texts_of(*pages):
    plan = W.plan_of(json.dumps(W.chosen(wrapper_of(*pages))))
    return [W.main_text(W.parse(p), plan) for p in pages]


def test_expression_is_union_free():
    a = "<ul><li>x</li><li>y</li></ul><div class=t>same</div><h2>one</h2><p>p1</p>"
    b = "<ul><li>z</li></ul><div class=t>same</div><p>p2</p><table><tr><td>1</td><td>2</td></tr></table><p>p3</p>"
    got = W.expression(wrapper_of(a, b))
    assert got == ('<#page><ul>(<li>#</>)+</> <div.t>"same"</> (<h2>"one"</>)? '
                   '(<p>#</> (<table><tr>(<td>#</>)+</></>)?)+</>')
    assert W.expression(wrapper_of(b, a)).count("<p>") == 1


def test_repeated_groups_of_several_items():
    dl = "<dl><dt>a</dt><dd>1</dd><dt>b</dt><dd>2</dd><dd>3</dd><dt>c</dt></dl>"
    assert W.expression(wrapper_of(dl)) == "<#page><dl>((<dt>#</>)? (<dd>#</>)?)+</></>"
    dl = "<dl><dt>a</dt><dd>1</dd><dt>b</dt><dd>2</dd><dt>c</dt></dl>"
    assert W.expression(wrapper_of(dl)) == "<#page><dl>(<dt>#</> (<dd>#</>)?)+</></>"


@pytest.mark.parametrize("seed", range(20))
def test_sequences_hold_a_label_once(seed):
    rng = np.random.default_rng(seed)

    def tree(depth):
        out = []
        for _ in range(rng.integers(0, 6)):
            tag = rng.choice(["p", "div", "h2", "ul", "section"])
            out.append(f"<{tag}>{'text ' if tag in ('p', 'h2') or not depth else tree(depth - 1)}</{tag}>")
        return "".join(out)

    pages = [page(tree(3)) for _ in range(12)]

    def check(seq):
        labels = [x for i in seq for x in W._labels(i)]
        assert len(labels) == len(set(labels)), labels
        for i in seq:
            for j in i[3] if i[0] == "+" else [i]:
                if j[0]:
                    check(j[3][1])

    w = wrapper_of(*pages)
    check(w[3][1])
    small = len(W.dumped(w))
    assert w[1] == 12 and json.loads(W.dumped(w)) == w
    # As large after the same pages again, but for the counts.
    assert len(W.dumped(W.merged(w, wrapper_of(*pages)))) < 1.2 * small + 200
    names = {above for above, _, _ in W._slots(w[3][1], (), False)}
    for p in pages:     # every slot of every page has its place in the wrapper
        assert {a for a, _ in W._named(W.parse(p), set(), ())} <= names


def test_article_without_the_rest_of_the_page():
    bodies = []
    for i in range(6):
        bodies.append(page(f"""<!-- x --><header class="site">Site {i}</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
          <div class="cookie-notice">We use cookies {i}</div><aside class=sidebar><p>Side {i}</p></aside>
          <article><h1>Title &amp; {i}</h1><script>var t="</p><p>no";</script><style>p{{}}</style>
          <p>First <b>bold</b>&nbsp;text
             of {i}<br>next line<p>Unclosed {i} &lt;p&gt;<div class="share">Share this</div>
          <ul><li>point {i}</ul><form><label>Mail</label><input name=a><p>Send</p></form>
          <p class="hint">Read our guide</p>
          <section class="comments"><p>Nice {i}</p></section></article>
          <div id="ad-{i}">Buy {i}</div><footer>&copy; {i}</footer>"""))
    bodies[3] = bodies[3].split("<form>")[0]      # cut short: nothing is closed
    for i, got in enumerate(texts_of(*bodies)):
        assert got == f"Title & {i}\nFirst bold text of {i} next line\nUnclosed {i} <p>\npoint {i}", got


def test_main_text_without_article_is_the_varying_one():
    pages = [page(f"<div class=top><a href=/a>Menu</a> <a href=/b>More</a></div><div class=claim>Always the same</div>"
                  f"<div class=body><h2>Head {i}</h2><p>{prose(i, 40)}</p><p>{prose(i + 50, 30)}</p></div>"
                  f"<div class=links><a href=x>{prose(i + 90, 6)}</a></div><div class=f>Small print</div>")
             for i in range(6)]
    assert texts_of(*pages) == [f"Head {i}\n{prose(i, 40)}\n{prose(i + 50, 30)}" for i in range(6)]
    mixed = [*pages, page("<article><p>Only this</p></article><div class=body><p>not this</p></div>")]
    assert texts_of(*mixed) == [*texts_of(*pages), "Only this"]


def test_copies_and_lone_pages_keep_their_article():
    p = page("<nav>N</nav><article><h1>H</h1><p>same text</p></article>")
    assert texts_of(p) == ["H\nsame text"] and texts_of(*[p] * 9) == ["H\nsame text"] * 9
    assert texts_of("plain text, no tags &amp; so on") == ["plain text, no tags & so on"]


def test_pages_table(spark):
    long = page("<article>" + "".join(f"<p>{prose(i, 50)}</p>" for i in range(2000)) + "</article>")
    rows = [(i, f"http://Hot.example:80/{i}" if i < 40 else f"https://h{i % 7}.example/x",
             page(f"<nav><a>n</a></nav><article><h1>H{i}</h1><p>{prose(i, 20)}</p></article><footer>F</footer>"), "c", "c")
            for i in range(60)]
    rows += [(None, None, None, "c", "c"), (100, "", "", "c", "c"), (101, None, rows[0][2], "c", "c"),
             (1, rows[1][1], rows[1][2], "c", "c"), (102, "nonsense", "<<<>>> <p", "c", "c"), (103, "http://l/", long, "c", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, plan string")
    got = extraction.extracted_pages(pages.repartition(5)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"H{i}\n{prose(i, 20)}" for i in range(60)) and text[101] == text[0]
    assert text[None] == "" and text[100] == "" and text[103].count("\n") == 1999
    assert extraction.extracted_pages(pages.limit(0)).collect() == []
    hosts = {r["host"]: json.loads(r["wrapper"])[1] for r in extraction.host_wrappers(pages.repartition(5)).collect()}
    assert hosts["hot.example"] == 41 and hosts[""] == 2


def test_pages_of_the_fixture(spark):
    """The articles as a regular expression made for this one template cuts them."""
    import html
    from quillmark.llm.catalog import QUERIES
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = QUERIES["op11_pages"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- spelling ------------------------------------------------------------------------------------

def brute_variants(counts):
    near, star = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            star[w[:k] + "\0" + w[k + 1:]].add(w)
            if (x := w[:k] + w[k + 1:]) in counts:
                near[w].add(x)
                near[x].add(w)
    for g in star.values():
        for a in g:
            near[a] |= g - {a}
    form = {}
    for w in counts:
        b = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = b if b is not None and counts[b] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        r = w
        while form[r] is not None:
            r = form[r]
        out[w] = (w, form[w], r, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("size", [3, 50_000])
def test_spelling_variants(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "RANGE_WORDS", size)
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 10))) for _ in range(150)} | {"aaaaaa", "aaaaaaa", "b" * 300}
    words |= {"b" * 299 + "a", "b" * 301, "abcdef", "bcdefa"}
    counts = {w: int(5 ** rng.integers(1, 6) + rng.integers(0, 3)) for w in words}
    counts |= {"chain" + "y" * k + "z" * (5 - k): 5 ** (k + 1) for k in range(6)}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    want = brute_variants(counts)
    assert {r["word"]: tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(len({v[1], v[2], w}) == 3 for w, v in want.items()) > 3     # forms of forms
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_node_numbers_are_prefixes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE_WORDS", 2)
    words = ["abc", "abcd", "abd", "b", "abcde", "abcdf", "abcdg", "c", "abcdh", "ab"]
    rows = spelling.trie_nodes(spark.createDataFrame(list(enumerate(words)), "id long, w string"), "x").collect()
    number, prefix = {}, {}
    for r in rows:
        for k, node in enumerate(r["x"]):
            p = words[r["id"]][:k]
            assert number.setdefault(p, node) == node and prefix.setdefault(node, p) == p
        assert len(r["x"]) == len(words[r["id"]]) + 1
    assert len(rows) == len(words)


def test_word_counts(docs, no_docs, fixture_rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = Counter()
    for i, t, *_ in fixture_rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(low)):
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                want[w] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, spelling.damaged).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5} and got
    assert spelling.word_counts(no_docs, spelling.damaged).collect() == []
    null_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    same = {r["word"]: r["n"] for r in spelling.word_counts(null_id, spelling.damaged).collect()}
    assert same == {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}


# --- runs ----------------------------------------------------------------------------------------

def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if (size := i + q - s) >= max(6, 4 * q):
                out.setdefault((s, size), q)
    return sorted(((s, size, q) for (s, size), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_numbers(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(rng.integers(1, 9)):
        n = int(rng.integers(0, 90))
        w = rng.integers(0, rng.integers(1, 5), n)
        if n > 10 and rng.random() < .6:
            p, a = int(rng.integers(1, 8)), int(rng.integers(0, n))
            for i in range(a + p, n):
                w[i] = w[i - p]
        docs.append(w.tolist())
    bounds = np.append(0, np.cumsum([len(d) for d in docs]))
    doc, start, length, period = runs.find_runs(np.array(sum(docs, []), np.int64), bounds)
    for k, w in enumerate(docs):
        here = doc == k
        assert list(zip(start[here], length[here], period[here], strict=True)) == brute_runs(w)


def test_extensions():
    rng = np.random.default_rng(3)
    for n, letters in ((30, 1), (200, 2), (2000, 3), (500, 40)):
        seq = np.concatenate([[90], rng.integers(0, letters, n), [91], rng.integers(0, letters, n), [92]])
        g = Grammar(seq)
        i, j = rng.integers(1, 2 * n, (2, 300))
        i, j = i[i != j], j[i != j]
        for back in (False, True):
            for a, b, got in zip(i, j, g.extend(i, j, back), strict=True):
                k = 0
                while seq[a] == seq[b]:
                    k, a, b = k + 1, *((a - 1, b - 1) if back else (a + 1, b + 1))
                assert got == k


def test_periodic_runs(docs, no_docs, fixture_rows):
    fixture_rows = [*fixture_rows, *((i, prose(i, 200), *[None] * 6) for i in range(100, 140))]
    docs = docs.sparkSession.createDataFrame(fixture_rows, docs.schema).repartition(3)
    got = {r["doc_id"]: r for r in runs.periodic_runs(runs.with_planted_repeats(docs)).collect()}
    assert len(got) == len(fixture_rows)
    planted = 0
    for i, t, *_ in fixture_rows:
        w = SPLIT.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + k % p] for k in range(len(w) - a)]
            planted += 1
        if len(w) < 5000:
            want = brute_runs(w)
            assert [tuple(r) for r in got[i]["runs"]] == want, i
        gone = {k for r in got[i]["runs"] for k in range(r["start"] + r["period"], r["start"] + r["length"])}
        assert got[i]["text"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert planted and [tuple(r) for r in got[13]["runs"]] == [(0, 300, 1)] and got[13]["text"] == "x"
    assert runs.periodic_runs(no_docs).collect() == []


def test_runs_of_null_ids_and_long_texts(spark):
    line = "one two three "
    rows = [(None, line * 5), (None, line * 5), (7, line * 100_000), (8, "w" * 3_000_000), (9, " ".join(["w"] * 400_000))]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], hashlib.md5(r["text"].encode()).hexdigest()) for r in got) == sorted(
        (str(i), r, hashlib.md5(t.encode()).hexdigest()) for i, r, t in [
            (None, [(0, 15, 3)], line[:-1]), (None, [(0, 15, 3)], line[:-1]), (7, [(0, 300_000, 3)], line[:-1]),
            (8, [], "w" * 3_000_000), (9, [(0, 400_000, 1)], "w")])


def test_spelling_joins_send_no_words_through_the_driver(spark, monkeypatch):
    """Tables that are over the broadcast bound, though Spark takes their files to be small."""
    from quillmark.operators import joins
    plans, write = {}, spelling.staged

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(spelling, "staged", staged)
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    counts = [("abcdefg", 100), ("abcdefgh", 10), ("abcdefghi", 2), ("abcdefgx", 11), ("qqqqqq", 7)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got == {"abcdefg": (None, "abcdefg", 100, 2, None), "abcdefgh": ("abcdefg", "abcdefg", 10, 3, 100),
                   "abcdefghi": ("abcdefgh", "abcdefg", 2, 1, 10), "abcdefgx": ("abcdefg", "abcdefg", 11, 2, 100),
                   "qqqqqq": (None, "qqqqqq", 7, 0, None)}
    for name in ("near-words", "word-forms", "roots"):
        assert "SortMergeJoin" in plans[name], name
    assert "BroadcastHashJoin" not in plans["word-forms"]
