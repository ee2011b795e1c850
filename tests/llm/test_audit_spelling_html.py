"""Filter audit, spelling variants and HTML extraction: brute force, odd rows and made pages."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bizlens.llm import filter_audit, html_extract, spelling
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, mask int, _text string, _h string"


# filter audit

def audit(docs, labels):
    """Every order run on every document, one filter after the other."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                      "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i})
    parts = [p or "" for _, _, p in docs]
    for part in set(parts):
        mine = [(f, d[0]) for f, d, p in zip(fails, docs, parts) if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for k, x in enumerate(order):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = {
                    "kept": len(left), "removed": len(gone), "redundant": sum(r[0][x] for r in mine) - len(gone),
                    "unique_fails": sum(r[0][x] and sum(r[0].values()) == 1 for r in mine),
                    "good_lost": sum(r[1] in good for r in gone), "toxic_lost": sum(r[1] in toxic for r in gone)}
        for (p, order, step), v in out.items():
            if p == part:
                v["shapley"] = shapley[order[step - 1]]
    return out


def test_filter_audit_against_every_order(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n\t", "A" * 9 + "b" * 81, "A" * 9 + "b" * 80, "x" * 50_000 + " #", "É" * 20]
    for _ in range(60):
        w = rng.choices(words[:rng.choice([90, 130, 400])], k=rng.choice([99, 100, 101, 160]))
        texts.append(" ".join(x.upper() if rng.random() < 0.05 else x for x in w) + rng.choice(["", "", " &", "$"]))
    docs = [(rng.randrange(90), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(400)]
    docs += [(None, texts[9], "en"), (None, texts[9], "de"), (7, texts[9], "en"), (7, texts[9], "en"), (500, "only here " * 60, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, p, 1, "clash", "clash") for i, t, p in docs], DOCS).repartition(5)
    got = rows(filter_audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = audit(docs, labels)
    assert len(got) == len(want) == 4 * 120 * 5
    for r in got:
        assert {k: r[k] for k in want["en", "ABCDE", 1]} == want[r["part"], r["filter_order"], r["step"]]


def test_sketch_clears_only_unique_texts(spark):
    df = spark.range(5000).selectExpr("id as _id", "xxhash64(least(id, 4000L)) as _h", "xxhash64(7, least(id, 4000L)) as _g").repartition(7)
    bits = spark.sparkContext.broadcast(filter_audit.counting_bloom(df))
    maybe = {r["_id"] for r in df.where(filter_audit.maybe_repeated(bits)).select("_id").collect()}
    assert set(range(4000, 5000)) <= maybe and len(maybe) < 1000 + 400
    small = filter_audit.Settings(max_bits=16, cells_per_row=1)  # a full sketch clears less, never a repeat
    full = spark.sparkContext.broadcast(filter_audit.counting_bloom(df, small))
    assert set(range(4000, 5000)) <= {r["_id"] for r in df.where(filter_audit.maybe_repeated(full)).select("_id").collect()}


def test_filter_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(docs, least):
    n = Counter()
    for i, t in docs:
        for w in RUN.findall(t or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= least}
    out = {}
    for w in n:
        close = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form = close[0] if close and n[close[0]] >= 2 * n[w] else None
        out[w] = {"n": n[w], "n_near": len(close), "form": form, "form_n": n.get(form)}
    for w in out:
        root = w
        while out[root]["form"]:
            root = out[root]["form"]
        out[w]["root"] = root
    return out


def test_spelling_against_all_pairs(spark):
    rng = random.Random(8)
    base = ["aaaaa", "aabbaa", "straße", "Größe", "naïveté", "x×÷yz", "letters", "banana", "aaabaaa"] + ["".join(rng.choices("abé", k=rng.randint(4, 7))) for _ in range(60)]

    def bent(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abü") + w[k + 1:], w.upper()])

    docs = [(rng.randrange(50), " ".join(bent(rng.choice(base[:rng.choice([9, 69])])) + rng.choice(["", ",", "1", "ā", "’s"]) for _ in range(200))) for _ in range(60)]
    docs += [(1, None), (2, ""), (None, "banana bananna bananas " * 30), (3, "-- 12 €"), (4, "Ã\u0083 " * 5 + "chain chainx chainxy " * 4 + "chainx chainxy " * 9 + "chainxy " * 40)]
    df = spark.createDataFrame([(i, t, "x", 0, "clash", "clash") for i, t in docs], DOCS).repartition(6)
    got = {r.pop("word"): r for r in rows(spelling.spelling_variants(df))}
    want = variants(docs, 3)
    assert got == want
    assert got["chain"]["root"] == "chainxy" and got["chain"]["form"] == "chainx"
    assert sum(v["form"] is not None for v in want.values()) > 20 and max(v["n_near"] for v in want.values()) > 5


def test_spelling_deletes_the_hashed_character(spark):
    docs = [(i, "Elephants elephants ELEPHANTS zebras") for i in range(2000)]
    got = {r.pop("word"): r for r in rows(spelling.spelling_variants(spark.createDataFrame([(*d, "x", 0, "", "") for d in docs], DOCS)))}
    assert got == variants(docs, 3) and len(got) > 8


def test_ranges_across_batches():
    import pyarrow as pa
    rng = random.Random(1)
    words = {"".join(rng.choices("ab", k=rng.randint(5, 7))): rng.randint(1, 9) for _ in range(90)}
    table = []
    for w, n in words.items():
        for j in range(2 * len(w) + 1):
            whole = j >= len(w)
            i = j - len(w) if whole else j
            table.append((w[i + (not whole):] + "$" + w[:i], whole, i == 0 or w[i - 1:i] != w[i:i + 1], w, n))
    table.sort(key=lambda r: (r[0], r[1], -r[4], r[3]))
    whole = pa.RecordBatch.from_pylist([dict(zip(("key", "whole", "first", "word", "n"), r)) for r in table])
    results = []
    for size in (1, 7, 10_000):
        total, best = Counter(), defaultdict(list)
        for b in spelling.scan_ranges(iter([whole.slice(k, size) for k in range(0, whole.num_rows, size)])):
            for r in b.to_pylist():
                total[r["word"]] += r["n_near"]
                best[r["word"]].append((-r["near_n"], r["near"]))
        results.append((dict(total), {w: min(v) for w, v in best.items()}))
    want = {w: [x for x in words if near(w, x)] for w in words}
    assert results[0] == results[1] == results[2]
    assert results[0] == ({w: len(v) for w, v in want.items() if v}, {w: min((-words[x], x) for x in v) for w, v in want.items() if v})


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0


# HTML extraction

PRIOR = np.array(html_extract.Settings().prior)
PROSE = "The council met on Tuesday, and after a long debate, its members agreed to repair the bridge over the river."


def text_of(html):
    return html_extract.main_text(html, PRIOR)


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        gain = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 8)) for _ in range(rng.randint(0, 14))]

        def cost(label):
            return sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        assert cost(html_extract.minimum_cut(gain, edges)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_long_chain_of_blocks():
    rng = random.Random(2)
    n = 20_000
    label = html_extract.minimum_cut([rng.randint(-50, 50) for _ in range(n)], [(i, i + 1, 40) for i in range(n - 1)] + [(i, i + 2, 20) for i in range(n - 2)])
    assert len(label) == n and any(label) and not all(label)


def test_article_without_its_surroundings():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
      <header><a href="/">Site</a><h2>Motto of the site</h2></header><nav><ul><li><a>Home<li><a>News</ul></nav><div class="cookie-notice">We use cookies, and more.</div>
      <main><article><header><h1>A &amp; B&nbsp; &lt;c&gt;</h1></header><p>{PROSE}<div class="ad">Buy now, it is cheap, really.</div>
      <p>One<br>two <b>th</b>ree&#33;</p><script>var t="</p><p>no</p>";</script><!-- <p>no</p> --><ul><li>First<li>Second</ul>
      <table><tr><td>x<td>y</table><form><label>Your name</label><input><button>Send</button></form></article>
      <section id="comments"><article class="comment"><p>{PROSE}</p></article></section></main>
      <aside><p>{PROSE}</p></aside><footer><p>&copy; 2020, all rights</p></footer></body></html>"""
    assert text_of(html) == "\n".join(["A & B <c>", PROSE, "One two three!", "First", "Second", "x", "y"])


def test_pages_without_article_marks():
    menu = "<div><a href=1>Home</a></div><div><a href=2>About us</a></div><div><a href=3>Contact</a></div>"
    body = f"<h1>Bridge repaired</h1><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p>"
    want = f"Bridge repaired\n{PROSE}\nYes.\n{PROSE}"
    assert text_of(f"<body><div>{menu}</div><div>{body}</div><div><div>© Copyright</div></div></body>") == want
    assert text_of(f"<form id=all><div class='page sidebar-left'><div class=menu>{menu}</div><div>{body}</div></div></form>") == want
    assert text_of(f"<div id=topbar>{menu}</div><div class=content>{body}</div><div class='related'><p>{PROSE}</p></div>") == want


@pytest.mark.parametrize("html", [None, "", " ", "<", "<<<", "<p", "</p></div>", "<!--", "<script>alert(1)", "<a href='x", "&", "<nav>Home</nav>"])
def test_pages_without_text(html):
    assert text_of(html).replace("<", "").replace("&", "") == ""


def test_broken_and_long_pages():
    assert text_of("<article><p>a < b & c &lt; d <i>e<p>f</article>") == "a < b & c < d e\nf"
    assert text_of(f"<article>{'<b><p>word' * 3000}") == "\n".join(["word"] * 3000)
    assert len(text_of("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>" + "long " * 200_000)) == 4 + 1 + 999_999


def test_html_extract_rows(spark):
    pages = [(1, "u", f"<nav>Home</nav><article><p>{PROSE}</p></article>"), (1, "u", None), (None, None, ""), (3, "v", f"<aside>x</aside><main><h1>Title</h1>{PROSE}</main>")]
    df = spark.createDataFrame([(*p, "clash", 3) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in rows(html_extract.html_extract(df)))
    assert got == [(0, "", "", 0), (1, "u", "", 0), (1, "u", PROSE, len(PROSE)), (3, "v", f"Title\n{PROSE}", len(PROSE) + 6)]
    assert html_extract.html_extract(df.where("false")).count() == 0


def test_classifier_learns_from_plain_markup(spark):
    """Link lists as articles, prose as adverts: the weights turn away from the prior."""
    html = "<article>" + "".join(f"<div><a>Item {k}</a></div>" for k in range(9)) + f"</article><div class=ad><p>{PROSE}</p><p>{PROSE}</p></div>"
    df = spark.createDataFrame([(k, "u", html) for k in range(60)], "page_id long, url string, html string")
    w = html_extract.fit(df)
    at = html_extract.FEATURES.index("link share")
    assert w[at] > PRIOR[at]
    assert (html_extract.fit(df.where("false")) == PRIOR).all()
