"""Language ID, HTML extraction and the pipeline."""

import html
import json
import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import bpe_chunks, covering_simhash, language_id, lsm_dedup, pseudonyms, wrappers

SYLLABLES = {"aa": ["la", "mo", "ri", "é"], "bb": ["sch", "ung", "ter", "ö"], "cc": ["tion", "ing", "the"]}


def corpus(n=240, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((k, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, score double")


def test_language_id_on_held_out_documents(spark):
    rows = corpus() + [(900, None, "aa"), (901, "", None), (902, "12 34 ---", "bb"), (903, "lamo rila", None), (None, "lamo rimo", "bb"), (904, "schung " * 20_000, None)]
    got = language_id.identify(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert np.mean([x.lang_pred == x.lang for x in held]) > 0.95 and len(held) > 50
    assert all(0 <= x.score <= 1 for x in got)
    assert [(by[k].lang_pred, by[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903].lang_pred == "aa" and by[904].lang_pred == "bb"


def test_held_out_labels_are_never_learned(spark):
    rows = corpus()
    spoiled = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = ({x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(frame(spark, r)).collect()} for r in (rows, spoiled))
    assert a == b


def test_without_labels_all_is_unknown(spark):
    got = language_id.identify(frame(spark, [(k, "text", None) for k in range(5)])).collect()
    assert {(x.lang_pred, x.score) for x in got} == {("und", 0.0)}
    assert language_id.identify(frame(spark, [])).collect() == []


def test_temperature_is_calibrated():
    r = np.random.default_rng(1)
    logits = r.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = [int(r.choice(3, p=q)) for q in p]
    assert 0.8 < language_id.best_temperature(list(logits), y) < 1.25
    assert 2.4 < language_id.best_temperature(list(logits * 3), y) < 3.7


def test_weights_are_sparse():
    ex = [(np.array([k % 5, 10 + k % 2]), np.array([0.1, 1.0]), k % 2) for k in range(200)]
    w = language_id.follow_the_leader(ex, 2, alpha=0.5, beta=1.0, l1=1.0, l2=0.1, epochs=2)
    assert np.count_nonzero(w[:, 10:12]) == 4 and np.count_nonzero(w[:, 20:-1]) == 0


# pages


def page(title, blocks, *, foot="", close=True, form=False):
    body = "".join(f"<p>{b}</p>" if k % 3 else f"<p><b>{b}<br>" for k, b in enumerate(blocks))
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home"><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">{title[:3]}</a></li></ul></nav>
<!-- ad --><div class="ad banner">Buy {title}</div>{'<form><input name=q>Search</form>' if form else ''}<article><h1>{title}</h1>{body}</article><div id="comments"><p>reader {title}</p></div><aside>side {title}</aside><footer>&copy; {foot}</footer>{'</body></html>' if close else ''}"""


def test_extraction(spark):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        blocks = [f"Block {k} {j} &amp; caf&eacute;\n\t{r.random()}" for j in range(r.randint(1, 9))]
        rows.append((k, f"https://Host{k % 4}.example.com/{k}?x=1", page(f"Title {k}", blocks, foot=str(k), close=k % 5 > 0, form=k % 3 == 0)))
        want[k] = " ".join([f"Title {k}", *(" ".join(html.unescape(b).split()) for b in blocks)])
    rows += [(100, None, None), (101, "odd", ""), (102, "https://one.example.com/", "just text < 3 &lt;b&gt;"), (103, rows[0][1], rows[0][2]), (104, "https://deep.example.com", "<div>" * 5000 + "deep" + "</div>" * 5000)]
    want |= {100: "", 101: "", 102: "just text < 3 <b>", 103: want[0], 104: "deep"}
    df = spark.createDataFrame([(*x, "path", "t") for x in rows], "page_id long, url string, html string, path string, text string")
    for bound in (8 << 20, 0):
        got = wrappers.extract(df.repartition(5), max_broadcast=bound).collect()
        assert {x.page_id: x.text for x in got} == want and len(got) == len(rows)
    assert wrappers.extract(df.limit(0)).collect() == []


def test_pages_without_an_article():
    p = """<html><body><header>H</header><div class="wrap"><div class="cookie-notice">c</div><div id="content"><h1>T &amp; U</h1><p>one <b>two</b>three<p>four<div class="comments"><p>bad</div><ul><li>x<li>y</ul></div><aside>s</aside></div><footer>f</footer>"""
    assert wrappers.main_text(p, None) == "T & U one twothree four x y"


def test_wrappers_generalise():
    """Repeats, options and slots of aligned pages."""
    a, b = (wrappers.expression(wrappers.parse(x), [str(k)]) for k, x in enumerate( ("<div><h1>A</h1><p>x</p><p>y</p></div>", "<div><h1>A</h1><h2>s</h2><p>z</p></div>")))
    (div,) = wrappers.merge(a, b)[1]
    assert [(k[0], k[2], k[3]) for k in div[1]] == [("h1", 0, 0), ("h2", 0, 1), ("p", 1, 0)]
    assert len(div[1][0][1][0][wrappers.TEXTS]) == 1 and len(div[1][2][1][0][wrappers.TEXTS]) == 3  # a constant and a slot
    rows = "<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"
    (dl,) = wrappers.expression(wrappers.parse(rows))[1]
    assert [(k[0], k[2]) for k in dl[1]] == [("(dt,dd)", 1)]


def learned(pages):
    """The rule that pages of one host give, as the tasks fold it."""
    from functools import reduce

    own = [wrappers.keyed(wrappers.parse(p)) for p in pages]
    return wrappers.rule_of(json.loads(json.dumps(reduce(wrappers.merge, own))))


def odd_page(k, body):
    """Class names that mean nothing; menus, notices and footers that all pages have, and a list of links."""
    links = "".join(f'<li><a href="/{k}{j}">Piece {k} {j}</a></li>' for j in range(6))
    return f'<html><body><div class="x1"><ul><li>Home<li>News<li>About us</ul></div><div class="x2"><div class="x3"><h1>Title {k}</h1>{body}<p>Write to us about this.</p></div><div class="x4"><ul>{links}</ul></div></div><div class="x5"><p>All rights reserved</p></div></body></html>'


def test_wrappers_decide_where_class_names_mean_nothing():
    bodies = [f"<p>Story {k} with words of its own.</p><p>More of {k}.</p>" for k in range(9)]
    pages = [odd_page(k, b) for k, b in enumerate(bodies)]
    rule = learned(pages)
    for k, p in enumerate(pages):
        assert wrappers.main_text(p, rule) == f"Title {k} Story {k} with words of its own. More of {k}."
        assert wrappers.main_text(p, None) != wrappers.main_text(p, rule)
    assert not learned(pages[:3]).drop  # too few pages to tell
    assert not learned([pages[0]] * 20).drop  # copies are one page


def test_copies_and_headings_stay_in_articles():
    near = [f"<html><body><article><h1>Same</h1><p>one text of all</p><p>and its end</p><p>copy {k}</p></article></body></html>" for k in range(12)]
    assert wrappers.main_text(near[3], learned(near)) == "Same one text of all and its end copy 3"
    pages = [f"<html><body><article><h2>Summary</h2><p>{'text ' * 9}{k}</p><p>Subscribe to our letters</p></article></body></html>" for k in range(12)]
    assert wrappers.main_text(pages[3], learned(pages)) == "Summary " + "text " * 9 + "3"


def test_a_host_outweighs_class_names():
    pages = [f'<html><body><div class="top">Site</div><div class="widget"><p>{"words " * 20}{k}</p></div></body></html>' for k in range(6)]
    assert wrappers.main_text(pages[2], learned(pages)) == "words " * 20 + "2"


def test_rules_do_not_depend_on_the_order():
    pages = [odd_page(k, f"<p>Body {k % 7}</p>" * (1 + k % 3)) for k in range(40)]
    want = learned(pages).written()
    r = random.Random(9)
    for _ in range(3):
        r.shuffle(pages)
        assert learned(pages).written() == want


ODD = {
    "<p title=don't>one two it's three</p><p>four</p>": "one two it's three four",
    "<article><h1>T</h1><div class='related-work'>work</div><div class='figure overlay'>fig</div><p>see <math><mi>x</mi></math></p></article>": "T work fig see x",
    "<nav>n</nav><header>site</header><article><header><h1>Own</h1></header><p>text</p><footer>f</footer></article>": "Own text",
    "<div>" * 300 + "x<nav>MENU</nav>" + "</div>" * 300: "x",
    "<article>a<div class='layout has-sidebar'>b</div><div class='elementor-widget-container'>c</div><div class='comments-area'>no</div></article>": "a b c",
    "<article class='post comment-open'>a</article>": "a",
    "<main class='content no-sidebar'>a<button>b</button><object>c</object></main>": "a c",
    "<div class='comments'>only this</div>": "only this",
    "<p title=\"a>b\">c</p><p class=d\"e>f": "c f",
    "<ul>" + "<li><div>a" * 500: " ".join(["a"] * 500),
    "<" * 3000 + "a": "<" * 3000 + "a",
    "<a " * 20000: "<a " * 20000,
    "</x>" * 5000 + "<div>" * 5000 + "</x>" * 5000 + "y": "y",
}


@pytest.mark.parametrize("page", ODD, ids=range(len(ODD)))
def test_odd_markup(page):
    assert wrappers.main_text(page, None) == ODD[page].strip()


# the pipeline


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    rows = corpus(150, 2)
    rows = [(i, t + ("\nAll rights reserved." if i % 3 == 0 else ""), lang, f"s{i % 4}", len(t)) for i, t, lang in rows]
    rows += [(300 + i, t.replace(" ", "  "), lang, "s0", 0) for i, t, lang in corpus(150, 2)[:20]]  # equal words
    rows += [(400, "---", "aa", "s1", 3), (401, None, None, None, None), (402, "mail la.mo@ri.example.com la mo " + " ".join(r.choice(SYLLABLES["aa"]) for _ in range(30)), "aa", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "pii", "packing"]
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, out[-1], None).write.parquet(path)
        out.append(spark.read.parquet(path))
        assert k == 4 or out[-1].columns == docs.columns
    texts = [{x.doc_id: x.text for x in d.collect()} for d in out[:5]]
    assert set(texts[0]) - set(texts[1]) == {400, 401}
    assert texts[2] == {i: t.removesuffix("\nAll rights reserved.") for i, t in texts[1].items()}
    assert all(k not in texts[3] for k in range(300, 320)) and {0, 1, 2, 402} <= set(texts[3])
    prints = {i: covering_simhash.simhash(t) for i, t in texts[2].items()}
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 2 for j in texts[2] if j < i) for i in set(texts[2]) - set(texts[3]))
    assert "la.mo@ri" not in texts[4][402] and re.search(r"[a-z]{2}\.[a-z]{2}@ri\.example\.com", texts[4][402])
    assert all(texts[4][i] == texts[3][i] for i in texts[3] if i != 402)
    packed = out[5].collect()
    path = bpe_chunks.default_path()
    for i, t in texts[4].items():
        own = sorted((x.start, x.length) for x in packed if x.doc_id == i)
        assert sum(n for _, n in own) == len(bpe_chunks.encode(path, t)) // 4 + 1


def test_everything_else_works_without_the_subpackage(tmp_path):
    """The driver deletes the subpackage, its tests and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    shutil.copytree(root / "palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)
    used = [p for p in (root / "palimpsest").rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
    assert not used
    assert lsm_dedup and pseudonyms and pytest


def test_template_texts_are_counted_over_all_pages(spark):
    """A text on 95 of 100 pages is template and one on 85 is not, wherever the pages that lack them have their keys."""
    head, rare = "Write to us about this.", "Read more of it below."

    def made(k, with_head, with_rare):
        return f"<html><body><article><h1>Title {k}</h1><p>Story {k} with words of its own and some more words to come.</p>{f'<div>{head}</div>' if with_head else ''}{f'<section>{rare}</section>' if with_rare else ''}</article></body></html>"

    def by_key(*has):
        return sorted(range(100), key=lambda k: wrappers.keyed(wrappers.parse(made(k, *has)))[wrappers.SEEN][0])

    bare = set(by_key(False, True)[:5])  # of the smallest keys of all
    less = set([k for k in by_key(True, False) if k not in bare][-15:])  # and of the largest
    rows = [(k, "https://h.example.com/", made(k, k not in bare, k not in less)) for k in range(100)]
    rows += [(100 + k, "https://h.example.com/", rows[0][2]) for k in range(50)]  # copies count once
    got = {x.page_id: x.text for x in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for k in range(100):
        want = f"Title {k} Story {k} with words of its own and some more words to come." + ("" if k in less else f" {rare}")
        assert got[k] == want
    assert all(got[100 + k] == got[0] for k in range(50))
