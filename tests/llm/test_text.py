"""HTML extraction, chat formatting and language ID."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, docs
from weft.llm import chat_format, html_text, langid, queries

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=sidebar>Side<p>more</div><article><header><h1>Head &amp; <i>line</i></h1></header><p><b>First&nbsp;para
 with  blanks<br>broken<p>Second &lt;tag&gt; &#x41;&eacute;<!-- no --><p hidden>secret</p><form><input value=x>Send<button>b</button></form>
<div class="ad">Buy</div><section class="comments"><p>Reader</p></section><ul><li>one<li>two</ul></article>
<aside>Aside</aside><footer>&copy; me</footer></body></html>"""


def test_declared_structure():
    text, zones = html_text.lines(PAGE)
    main = [t for t, z in zip(text, zones) if z == html_text.MAIN]
    assert main == ["Head & line", "First para with blanks broken", "Second <tag> Aé", "one", "two"]
    assert not [t for t, z in zip(text, zones) if z == html_text.OPEN]


@pytest.mark.parametrize("html,want", [
    ("", []), ("plain text", ["plain text"]), ("a < b and c > d", ["a < b and c > d"]), ("<p>x<p>y</p></div></p>z", ["x", "y", "z"]),
    ("<script>never closed <p>x", []), ("<p>open <b>tags <i>here", ["open tags here"]), ("<p title='a>b'>q</p>", ["q"]),
    ("x<!-- never closed", ["x"]), ("<div><span>in</span>line</div>", ["inline"]), ("<head><title>t</title><body>b", ["b"]),
    ("<br><p> </p><p>&nbsp;</p>", []),
])
def test_lines(html, want):
    assert html_text.lines(html)[0] == want


@pytest.mark.parametrize("tag,zone", [
    ('article style="overflow: hidden"', 0), ('article data-state="hidden" title="a hidden class=ad"', 0), ("article title='x' data-hidden=1", 0),
    ('div title="The hidden river"', 1), ('div data-class="ad"', 1), ("div data-x='a class=ad b'", 1), ("div title=a/hidden", 1),
    ('article class="post has-sidebar comments-open"', 0), ('main class="search"', 0), ('div class="main" class="ad"', 1),
    ("article hidden", 2), ("article HIDDEN", 2), ('p title="x"hidden', 2), ("div hidden=until-found", 2), ("div aria-hidden = 'true'", 2),
    ("div class=ad", 2), ('div title="a" class = "x ad"', 2), ('article class="comment"', 2), ('article class="comment-body" id=x', 2),
    ('article id="div-comment-12"', 2), ('div class="comment" role="article"', 2), ('div role="article" class="comment"', 2),
])
def test_attributes_are_names_with_whole_values(tag, zone):
    assert html_text.lines(f"<{tag}>text</{tag.split()[0]}>") == (["text"], [zone])


def test_nested_comment_articles_go():
    text, zones = html_text.lines('<article>Body<article class="comment depth-1">Reader<p>more</article>End</article><article class="comment">Other</article>')
    assert [t for t, z in zip(text, zones) if z == html_text.MAIN] == ["Body", "End"]


def test_long_blanks_in_tags_are_linear():
    assert html_text.lines("<p a" + " " * 200_000 + "= b" + " " * 200_000 + ">x")[0] == ["x"]


def test_long_nesting_is_linear():
    page = "<div>" * 3000 + "<article>" + "<p>word " * 20000 + "</article>"
    text, _ = html_text.lines(page)
    assert len(text) == 20000


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("cells", [1 << 22, 8])
def test_common_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_text, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in "ab")
        got = html_text.common(np.array(a, np.int64), np.array(b, np.int64))
        assert len(got) == plain_lcs(a, b) and got == sorted(set(got))
        it = iter(b)
        assert all(a[i] in it for i in got)  # a subsequence of b too


def test_whole_table_articles(spark):
    """The table's pages: everything inside <article>, cleaned by plain rules."""
    got = {r.page_id: r for r in queries.op6_html_text(spark, SF).collect()}
    import html as h
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        lines = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " " if "br" else "", re.sub(r"</?b>", "", p)))).strip() for p in parts]
        want = "\n".join(x for x in lines if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def pages(spark, rows):
    return spark.createDataFrame([(*r, "u", "h") for r in rows], "page_id long, url string, html string, uid string, host string")


def test_template_lines_are_deleted_by_nearest_url(spark):
    body = "<div>Top</div><div>{}</div><div>{}</div><div>Bottom</div>"
    rows = [(1, "http://h.org/a/1?x=1", body.format("alpha", "Rubric A")), (2, "https://h.org/a/2/", body.format("beta", "Rubric A")),
            (3, "http://H.org/b/9", body.format("gamma", "Rubric B")), (4, "http://other.org/a/1", body.format("delta", "Rubric A")),
            (5, None, body.format("eps", "x")), (6, "http://z.org/", None), (7, "http://z.org/1", ""), (7, "http://z.org/1", "")]
    got = sorted((r.page_id, r.text) for r in html_text.main_text(pages(spark, rows)).collect())
    assert got == [(1, "alpha"), (2, "beta"), (3, "gamma\nRubric B"), (4, "Top\ndelta\nRubric A\nBottom"), (5, "Top\neps\nx\nBottom"),
                   (6, ""), (7, ""), (7, "")]
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_copies_on_a_host_keep_their_text(spark):
    """Copies pair with the nearest page that has other lines, or with none; all rows of a group are told alike."""
    body = "<div>Top</div><div>{}</div><div>Bottom</div>"
    rows = [(1, "http://c.org/a", body.format("alpha")), (2, "http://c.org/a?id=2", body.format("alpha")), (3, "https://c.org/a/", body.format("alpha")),
            (4, "http://d.org/a/1", body.format("beta")), (5, "http://d.org/a/1?id=5", body.format("beta")), (6, "http://d.org/a/2", body.format("gamma")),
            (7, "http://d.org/z", body.format("beta")), (8, "http://e.org/1", body.format("beta"))]
    got = sorted((r.page_id, r.text, r.n_template) for r in html_text.main_text(pages(spark, rows)).collect())
    assert got == [*((i, "Top\nalpha\nBottom", 0) for i in (1, 2, 3)), (4, "beta", 2), (5, "beta", 2), (6, "gamma", 2), (7, "beta", 2),
                   (8, "Top\nbeta\nBottom", 0)]


def test_neighbours_over_many_ranges(spark):
    rng = random.Random(4)
    keys = [(f"u{i}", "big.org" if i % 3 else f"h{i % 7}.org", f"/{rng.choice('abc')}/{rng.randrange(30)}") for i in range(400)] + [("lone", "lone.org", "/")]
    got = {r.uid: r.partner for r in html_text.neighbours(spark.createDataFrame(keys, "uid string, host string, path string")).collect()}
    order = sorted(keys, key=lambda k: (k[1], k[2], k[0]))
    def same(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n
    want = {}
    for i, (u, h, p) in enumerate(order):
        near = [(same(p, order[j][2]), -j, order[j][0]) for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][1] == h]
        if near:
            want[u] = max(near)[2]
    assert got == want


# --- chat ---------------------------------------------------------------------------------

def plain_chat(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    esc = lambda s: s.replace("\\", "\\s").replace("<", "\\l").replace(">", "\\g")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss),
                    sum(len(f"<turn:{esc(r)}>{esc(x)}</turn>\n") for _, r, x in turns)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_chat_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.HOSTILE), (-7, 1, "assistant", queries.HOSTILE)]
    assert sorted(map(tuple, queries.op7_chat_format(spark, SF).collect())) == sorted(plain_chat(rows))


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "a<b>c\\d</turn>\n<turn:user>x\\s\\l"), (1, 1, "assistant", None), (1, 1, "assistant", "twice"), (1, 1, "assistant", "twice"),
            (1, None, None, "no role"), (2, 0, "assi>st<ant", ""), (None, None, None, None), (3, 5, "assistant", "é👩‍👧 " * 2000)]
    df = spark.createDataFrame([(*r, "p", "l") for r in rows], "conv_id long, turn long, role string, text string, piece string, loss string")
    pieces = chat_format.format_turns(chat_format.turns_of_table(df))
    parsed = chat_format.parse_turns(pieces)
    assert sorted(map(tuple, parsed.select("conv_id", "turn", "role", "text").collect()), key=key) == \
        sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=key)
    assert sorted(map(tuple, chat_format.conversation_digests(parsed).collect()), key=key) == sorted(plain_chat(rows), key=key)
    assert chat_format.conversation_digests(chat_format.parse_turns(chat_format.format_turns(chat_format.turns_of_table(df.limit(0))))).count() == 0
    with pytest.raises(ValueError):
        chat_format.turns_of_table(df.drop("turn"))


def test_record_layouts_with_further_keys(spark):
    rows = [(1, '{"id":7,"messages":[{"role":"user","content":"q","name":"x"},{"role":"assistant","content":"a"}]}'),
            (2, '{"id":7,"messages":[],"meta":{"text":"t"}}'), (3, '{"prompt":"q","completion":"a","score":0.5,"text":"z"}'),
            (4, '{"messages":[{"role":"user"},{"content":"a"}]}'), (5, '{"messages":"q"}'), (6, '{"prompt":"q","answer":"a"}'),
            (7, '["messages"]'), (8, '{"messages":[{"from":"user","value":"q"}]}')]
    found = chat_format.turns_of_records(spark.createDataFrame(rows, "id long, rec string"), "id", "rec")
    got = {}
    for r in found.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "q"), ("assistant", "a")], 3: [("user", "q"), ("assistant", "a")], 4: [("user", None), (None, "a")],
                   **{i: [(None, None)] for i in (5, 6, 7, 8)}}
    layout = {r.conv_id: r.layout for r in found.collect()}
    assert layout[1] == chat_format.fingerprint_of(["messages[].role", "messages[].content"])


def test_mixed_record_layouts(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}'),
            (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'),
            (3, '{"prompt":"q","completion":"a"}'), (4, '{"output":"a","instruction":"do","input":"this"}'),
            (5, '{"instruction":"do","input":"","output":"a"}'), (6, '{"question":"q","answer":1.5}'), (7, '{"strange":1}'), (8, "not json"),
            (9, None), (10, '{"messages":[]}'), (11, '{"messages":[{"role":"Human ","content":null}]}'), (12, '{"system":"s","prompt":"q","completion":"a"}')]
    got = {}
    for r in chat_format.turns_of_records(spark.createDataFrame(rows, "id long, rec string"), "id", "rec").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[1] == got[2] == got[3] == [("user", "q"), ("assistant", "a")]
    assert got[4] == [("user", "do\n\nthis"), ("assistant", "a")] and got[5] == [("user", "do"), ("assistant", "a")]
    assert got[6] == [("user", "q"), ("assistant", "1.5")] and got[7] == got[8] == got[9] == [(None, None)]
    assert got[11] == [("user", None)] and got[12][0] == ("system", "s")
    prints = chat_format.turns_of_records(spark.createDataFrame(rows, "id long, rec string"), "id", "rec")
    assert prints.where("conv_id in (4, 5)").select("layout").distinct().count() == 1
    assert chat_format.field_paths(spark.createDataFrame([], "a long, m array<struct<r:string,c:struct<x:int>>>").schema) == ["a", "m[].r", "m[].c.x"]


# --- language -----------------------------------------------------------------------------

def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op9_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert sum(r.rejected for r in got) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got)


GIBBERISH = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz   ", k=k)) for i, k in enumerate([60, 200, 1000] * 5)]


def test_language_rejects_what_was_not_learned(spark):
    """Each language in turn left out of the training, and gibberish; held-out rows of the others stay."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
            if langid.has_letter(r.text or "")]
    counts = {r.doc_id: langid.bucket_counts(r.text) for r in rows}
    learn, held = ([r for r in rows if (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == h] for h in (False, True))
    foreign = ["съешь же ещё этих мягких французских булок да выпей чаю", "日本語の文章を書いています。今日は天気がいいです。",
               "a gyors barna róka átugrik a lusta kutya felett minden reggel"]
    for out in [None, *sorted({r.lang for r in rows})]:
        use = [r for r in learn if r.lang != out]
        m = langid.fit(np.array([counts[r.doc_id] for r in use], np.float32), [r.lang for r in use])
        clean = [m.predict(r.text)[2] for r in held if r.lang != out]
        assert sum(clean) <= 0.02 * len(clean), out
        assert all(m.predict(t)[2] for t in GIBBERISH + foreign), out
        other = [m.predict(r.text)[2] for r in rows if r.lang == out]
        assert sum(other) >= 0.9 * len(other), out


def test_language_sample_is_bounded_in_rows(spark, monkeypatch):
    """Null and repeated ids, repeated rows: at most per_language rows a language are fetched, and enough of them."""
    seen = []
    monkeypatch.setattr(langid, "fit", lambda counts, lang: seen.append(sorted(lang)))
    rows = [(None, f"no id {'x' * i}", "en") for i in range(300)] + [(1, f"one id {'y' * i}", "de") for i in range(300)] \
        + [(2, "always the same", "fr")] * 300 + [(i, "one text", "es") for i in range(3, 303)] \
        + [(2, "most are one row", "it")] * 300 + [(i, f"these differ {i}", "it") for i in range(1000, 1008)]
    langid.train(docs(spark, rows), per_language=20)
    got = {k: seen[0].count(k) for k in ("en", "de", "fr", "es", "it")}
    taught = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (2, *range(1000, 1008)))
    assert got == {"en": 20, "de": 20, "fr": 1, "es": 20, "it": taught}


def test_language_odd_rows(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    told = {r.doc_id: r for r in langid.identify(docs(spark, ODD).drop("score"), model).collect()}
    for i in (3, 4, 5):
        assert told[i].lang_pred == "und" and told[i].score == 0 and told[i].rejected
    digits = langid.identify(docs(spark, [(1, "12 34 !!"), (2, "日本")]).drop("score"), model).collect()
    assert [r.lang_pred == "und" for r in digits] == [True, False]
    assert langid.identify(docs(spark, []).drop("score"), model).count() == 0
    nothing = langid.train(docs(spark, ODD))  # no labels
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD).drop("score"), nothing).collect()} == {"und"}
    one = langid.train(docs(spark, [(i, "some text here", "en") for i in range(10)]))
    assert [r.lang_pred for r in langid.identify(docs(spark, [(1, "hello")]).drop("score"), one).collect()] == ["en"]


def test_buckets_in_windows(monkeypatch):
    text = "Straße und ÉCOLE, 12 words—äöü " * 40
    whole = langid.bucket_counts(text)
    b = bytes(langid.letters(text))
    n = sum(1 for k in langid.GRAMS for i in range(len(b) - k + 1) if 0 not in b[i + 1:i + k - 1])
    assert whole.sum() == n and b"\0\0" not in b
    monkeypatch.setattr(langid, "WINDOW", 17)
    assert (langid.bucket_counts(text) == whole).all()
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    assert np.allclose(m.logits(text), whole @ m.table / whole.sum(), atol=1e-4)
