"""Quality rules, mixing, line dedup and HTML against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratlas.llm import html_text, lines, mixing, quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"wort{i % 700}" for i in range(20_000))
TEXTS = [None, "", "  \n\t ", "a", "a b c", "a b c a b c", "x y x y x y x y", "eins\neins\n\nzwei\neins", "# * $ %% &|<>", LONG, "wort " * 5000, "é ü x\x1cy z", "x\x0by\x0cz\r\nw", "a b a b c"]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "de", f"s{i % 3}" if i % 7 else None, len(t) if t else 0) for i, t in enumerate(texts)], DOCS)


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full), len(full) - len(set(full)), len(covered)


def test_measures(spark):
    got = quality.measures(frame(spark, TEXTS)).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == measured(t), t and t[:30]


def test_ledger_and_ablation(spark):
    good = " ".join(f"wort{i}" for i in range(60))
    df = frame(spark, [good, good + " ###" * 20, "kurz", "a b c " * 40, None]).withColumn("n_words", F.lit("clash")).withColumn("fail_bits", F.lit(7))
    book = quality.ledger(df)
    assert [r.fail_bits for r in book.orderBy("doc_id").collect()] == [0, 4, 1, 34, 1]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]
    a = {r.rule: (r.n_failed, r.n_only, r.n_kept_without, r.n_kept) for r in quality.ablation(book).collect()}
    assert a["too_few_words"] == (2, 2, 3, 1) and a["symbols"] == (1, 1, 2, 1) and a["repeated_windows"] == (1, 0, 1, 1)
    assert {tuple(r)[1:] for r in quality.ablation(book.limit(0)).collect()} == {(0, 0, 0, 0)}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, cap = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in cap]
        rest = total - sum(cap.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 2 * sizes[s]]
        if not over:
            return t | cap
        cap |= {s: 2 * sizes[s] for s in over}


def test_mixing(spark):
    texts = [" ".join(["w"] * (i % 13 * (1 + 20 * (i % 3 == 1)))) for i in range(400)] + [None, ""]
    docs = frame(spark, texts)
    docs = docs.unionAll(docs.where("doc_id < 3")).withColumn("doc_id", F.when(F.col("doc_id") != 9, F.col("doc_id")))
    plan = mixing.mix_plan(docs).collect()
    sizes, took, target = Counter(), Counter(), {}
    for r in plan:
        sizes[r.source] += r.size
        took[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.size >= 0
    want = brute_targets(sizes)
    assert len(plan) == 405
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(took[s] - want[s]) <= 3
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert Counter(map(tuple, plan)) == Counter(map(tuple, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {s: n for s, n in took.items() if n} == dict(words)
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def brute_lines(rows, chars=40, docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        full = (t or "").split("\n")
        stay = [x for x in full if not (len(holders.get(key(x), ())) >= docs and max(holders[key(x)]) != i)]
        out[i] = (len(full), len(full) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def test_line_dedup(spark):
    a, b, c = "Ä" * 39, "Diese Zeile steht in VIELEN Texten und ist lang", "Eine weitere lange Zeile, die nur in vieren steht"
    rows = [(i, f"{a}\n  {b.upper() if i % 2 else b}\t\n{c if i < 4 else i}\n{b}\r") for i in range(8)] + [(8, None), (9, ""), (10, b + " "), (11, "\n\n"), (12, "\n".join([b] * 3000))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, b)] * 2 + [(i, b) for i in range(5)], "doc_id bigint, text string")
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped) for r in lines.dedup_lines(nulls).collect()) == [(-1, 1), (-1, 1), (0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


def test_line_dedup_with_more_shared_lines_than_travel(spark):
    a, b = "Diese Zeile steht in VIELEN Texten und ist lang", "Eine weitere lange Zeile, die in allen Texten steht"
    rows = [(i, f"{a}\n{b}\n{i}") for i in range(9)] + [(9, None), (10, b), (10, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__bad", F.lit("clash"))
    take = lambda **more: sorted((r.doc_id, r.n_lines, r.n_dropped, r.text, r["__bad"]) for r in lines.dedup_lines(df, **more).collect())
    assert take() == take(most_shared=0)
    nulls = spark.createDataFrame([(None, a), (None, b), (None, "x")] + [(i, a) for i in range(5)], "doc_id bigint, text string")
    assert sorted((r.text, r.n_dropped) for r in lines.dedup_lines(nulls, most_shared=0).where("doc_id IS NULL").collect()) == [("", 1), (b, 0), ("x", 0)]


def test_repeated_windows_are_compared_by_their_words(spark):
    words = [f"w{i}" for i in range(300_000)]
    got = quality.measures(frame(spark, [" ".join(words), " ".join([*words, *words[:4]])])).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [0, 8]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><div class="cookie-notice"><p>Wir verwenden Cookies und mehr davon.</p></div>
<header><h1>Zeitung</h1></header><nav><ul><li><a href=/a>Start</a></ul></nav><!-- ad --><div class="ad">Kauf das und die und der und das.</div>
<article><h1>Kopf &amp; Fuß</h1><p>Der <b>erste</b> Ab\n  satz &lt;x&gt;.<br>Ende<p>Kurz.<aside>Am Rand</aside><div class=related><a href=x>mehr</a></div><form><input><label>Name</label></form><p>Zweiter&nbsp;Teil</p>
<section id="comments"><article class="comment"><p>Ein Kommentar der Leser und der Leserinnen.</p></article></section></article><footer>&copy; Zeitung</footer>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Kopf & Fuß Der erste Ab satz <x>. Ende Kurz. Zweiter Teil"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a href=x>y</a></nav>") == ""


@pytest.mark.parametrize("tag", ["<svg viewBox='0 0 1 1'/>", "<button>Teilen", "<datalist id=d><option>A<option>B</datalist>", "<video-player src=x></video-player>", "<button-group>", "<svg><path d=M0>", "<iframe src=x />", "<textarea>", "<video src=x>", "<select><option>A<option>B", "<object data=x></object>", "<select><option>A</select>"])
def test_html_goes_on_after_unclosed_elements(tag):
    assert html_text.main_text(f"<article><p>Eins.</p><div>{tag}</div><p>Zwei.</p>{tag}<p>Drei.</p></article><p>Aus</p>") == "Eins. Zwei. Drei."
    assert html_text.main_text(f"<article><p>Eins <svg><g><text>x</text></g></svg>mal<button>Teilen</button> zwei.</p></article>") == "Eins mal zwei."


def test_html_script_without_end():
    assert html_text.main_text("<article><p>Eins.</p><script>if (a < b) <p>x</p>") == "Eins."
    assert html_text.main_text("<article><p>Eins.</p><script-x></script-x><p>Zwei.</p></article>") == "Eins. Zwei."


@pytest.mark.parametrize("page", ["<div class='content has-sidebar'><article>{}</article></div>", "<main class='with-sidebar'>{}</main>", "<article class='post no-comments'>{}</article>", "<div class='overlay'><main>{}</main></div>", "<div id=search><article>{}</article></div>"])
def test_html_marks_are_whole_names(page):
    text = "<p>Der Rat hat die Vorlage beschlossen.</p>"
    assert html_text.main_text(page.format(text + "<div class='cookie-notice'>Kekse</div><div class='ad ad-2'>Kauf</div>")) == "Der Rat hat die Vorlage beschlossen."
    after = "<section id=comments><article><p>Ein Kommentar.</p></article></section>"
    if "overlay" not in page and "search" not in page:
        assert html_text.main_text(page.format(text) + after) == "Der Rat hat die Vorlage beschlossen."


def test_html_without_article():
    body = "The cat and the dog are in the house of the man who was with them for a long time, and it is what they want to do there. "
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><h2>Title</h2><p>{body * 3}</p><p>Yes.</p><p>{body * 2}</p><div><a href=3>One</a><a href=4>Two</a></div><p>(c)</p>"
    assert html_text.main_text(page) == " ".join(f"Title {body * 3} Yes. {body * 2}".split())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/=\"'!-ab&;# \n", max_size=60))
def test_html_never_fails(x):
    assert isinstance(html_text.main_text("<article>" + x), str)


PROSE = ["The council of the town has met and it was long.", "Der Rat hat die Vorlage für das neue Haus beschlossen, und sie ist gut.", "Le conseil de la ville est pour le projet et il a voté.", "Zażółć gęślą jaźń w każdym razie, powiedziała wczoraj rzeczniczka urzędu miasta na spotkaniu."]


@pytest.mark.parametrize(
    "page",
    [
        "<article data-topic='hidden gems'><p>{}</p></article>",
        "<article><p title='the hidden valley'>{}</p></article>",
        "<article><p>{}</p><datalist><option value=a></datalist></article>",
        "<article><svg/><p>{}</p></article>",
        "<article><iframe/><p>{}</p></article>",
        "<article><p class='share-price'>{}</p></article>",
        "<article><div class='side-by-side'><p>{}</p></div></article>",
        "<article><div id='search-for-truth'><p>{}</p></div></article>",
        "<article><p class='reply'>{}</p></article>",
        "<article><p><a href=x>{}</a></p></article>",
        "<article><p><math><mtext>{}</mtext></math></p></article>",
        "<article><p title=it's>{}</p></article>",
        "<article><p title='a > b'>{}</p><aside>x</aside></article>",
    ],
)
def test_html_loses_no_article_text(page):
    body = " ".join(PROSE[:2] * 3)
    assert html_text.main_text(page.format(body)) == body


SENTENCE = "The council has decided that the bridge over the river will be open for all of the people by the end of this year."


@pytest.mark.parametrize("name", ["user-comments", "comment-list", "ad-slot", "advertisement-box", "promo-box", "related-articles", "gdpr-cookie-notice-wrapper", "share-buttons", "article-footer", "nav-links"])
def test_html_marks_with_words_of_structure(name):
    text = f"<a href=/x>Share this page</a>" if name == "share-buttons" else f"<p>{SENTENCE * 3}</p>"
    page = f"<article><p>{SENTENCE * 2}</p><div class='{name}'>{text}</div><p>{SENTENCE}</p></article>"
    assert html_text.main_text(page) == " ".join([SENTENCE * 2, SENTENCE])
    assert html_text.main_text(page.replace(name, f"wide {name} x-1")) == html_text.main_text(page)


@pytest.mark.parametrize("name", ["site-header", "main-nav", "comments-section", "page-footer"])
def test_html_marks_without_article(name):
    assert html_text.main_text(f"<div class='{name}'><p>{SENTENCE * 3}</p></div><div class='main-content'><p>{SENTENCE * 2}</p></div>") == SENTENCE * 2


@pytest.mark.parametrize("name", ["has-sidebar", "with-comments", "no-ads", "is-menu-open", "main-content", "article-header", "post-body", "content"])
def test_html_names_that_mark_nothing(name):
    assert html_text.main_text(f"<article class='{name}'><div class='{name}'><h1>Bridge</h1><p>{SENTENCE * 2}</p></div></article>") == f"Bridge {SENTENCE * 2}"


def test_html_keeps_linked_items_and_short_pages():
    items = "".join(f"<li><a href=/{i}>Source number {i}</a></li>" for i in range(3))
    assert html_text.main_text(f"<article><p>{SENTENCE * 2}</p><ul>{items}</ul><p>{SENTENCE * 2}</p></article>") == f"{SENTENCE * 2} Source number 0 Source number 1 Source number 2 {SENTENCE * 2}"
    short = ["The bridge is open.", "It was built by the city for all of us.", "He was the first to walk on it."]
    menu = "<ul class=menu><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"
    assert html_text.main_text(menu + "".join(f"<p>{x}</p>" for x in short) + "<div class=site-footer><p>Written by the team of the site.</p></div>") == " ".join(short)
    assert html_text.main_text(menu + "<p>Login</p><p>Imprint</p><p>Contact 2025</p>") == ""


def test_html_without_article_in_another_language():
    body = " ".join(PROSE[3:] * 4)
    menu = "".join(f"<li><a href=/{i}>Strona {i}</a></li>" for i in range(9))
    assert html_text.main_text(f"<ul>{menu}</ul><h1>Tytuł</h1><div><p>{body}</p><p>{body}</p></div><p>Kontakt</p>") == f"Tytuł {body} {body} Kontakt"


def test_html_density_decides_generated_pages():
    rnd = random.Random(8)
    rules = Counter()
    noise = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='/{i}'>Seite {i}</a></li>" for i in range(rnd.randrange(1, 9))) + "</ul></nav>",
        lambda: f"<div class='{rnd.choice(['ad', 'advert banner', 'cookie-notice', 'sidebar', 'newsletter'])}'><p>{rnd.choice(PROSE)}</p></div>",
        lambda: "<script>var a = '<p>nicht</p>';</script><style>p { margin: 0 }</style><!-- <p>nie</p> -->",
        lambda: f"<form><label>Name</label><input name=q><button>Senden</button><p>{rnd.choice(PROSE)}</p></form>",
        lambda: f"<ol class=comments><li>{' '.join(rnd.choices(PROSE, k=3))}</li></ol>",
        lambda: f"<footer>&copy; 2026 {rnd.choice(PROSE)}</footer>",
    ]
    for _ in range(300):
        want, inner = [], ""
        for k in range(rnd.randrange(1, 9)):
            text = rnd.choice(["Kurz.", "Ja & nein.", f"Teil {k}"]) if k and rnd.random() < 0.3 else " ".join(rnd.choices(PROSE[:3], k=rnd.randrange(2, 7)))
            tag = rnd.choice(["p", "div", "blockquote", "h2" if len(text) < 60 else "p"])
            want.append(text)
            inner += f"<{tag}>{text.replace('&', '&amp;')}" + (f"</{tag}>" if tag != "p" or rnd.random() < 0.8 else "")
            if rnd.random() < 0.2:
                inner += rnd.choice(noise[1:4])()
        outer = lambda: "".join(f() for f in rnd.sample(noise, rnd.randrange(4)))
        page = f"<!DOCTYPE html><html><head><title>Titel</title></head><body>{outer()}<{'article'}>{inner}</article>{outer()}</body></html>"
        assert html_text.main_text(page) == " ".join(want), page
        rules.update(b.rule for b in html_text.labelled(page))
    assert rules["links"] + rules["stop words"] + rules["length"] > rules["place"] + rules["outside"]


@pytest.mark.parametrize("page", ["<div>x" * 160_000, "<p " * 330_000, '<a "' * 250_000, '<a b="' * 160_000 + ">", "<div>" * 100_000 + "</p>" * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<ul><li>x" * 110_000, "<body><div>" * 90_000, "<textarea>" * 100_000])
def test_html_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id, len(r.text)) for r in got) == [(1, 57), (1, 57), (2, 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
