import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm.leakage import leaked_items
from keyloom.llm.packing import TOKENIZER, best_filling, fill_rate, minimum_bin_slack, pack, token_counts
from keyloom.llm.residue import clean, is_residue, lines, residue_documents, residue_signs
from keyloom.llm.text import words, words_with_spans

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="the tokenizer files are not here")
ITEM = "When the old lighthouse keeper counted seven lamps in 1912, who lit the eighth one before dawn? Nobody did."


def test_words_ignore_form():
    plain = words("The cafe's ffi value is 12 and more")
    assert words("<p>The <b>cafe</b>&#8217;s &#xFB03; VALUE is​ １２ &amp;amp; a­nd **more**</p>") == plain
    assert words("") == [] and words("***") == []


@given(st.text(alphabet=st.sampled_from("ab Z9é<b></b>&amp;​ .ß\n"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_spans_name_the_same_words(text):
    spans = words_with_spans(text)
    assert all(0 <= s < e <= len(text) for _, s, e in spans)
    if "<" not in text and "&" not in text:
        assert [w for w, _, _ in spans] == words(text)


def leak(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return leaked_items(d, i, **kw)


def test_leakage(spark):
    w = ITEM.split()
    docs = [
        (1, "before " + ITEM + " after", 0), (2, "x " + " ".join(w[3:15]) + " y", 0), (3, "x " + " ".join(w[3:14]) + " y", 0), (4, None, 0), (5, "  ", 0), (6, ITEM.upper().replace(" ", " - "), 0),
        (7, "<em>" + ITEM.replace(" ", "</em>&nbsp;<em>") + "</em>", 0), (8, " ".join("zzz" if i % 7 == 0 else x for i, x in enumerate(w)), 0), (9, "filler " * 20000 + ITEM, 0), (9, ITEM, 0),
    ]
    got = leak(spark, docs)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 6, 7, 9, 9]
    passage = leak(spark, docs, with_spans=True).where("doc_id = 2").first()
    assert docs[1][1][passage.start : passage.end] == " ".join(w[3:15]).rstrip(",?.") and passage.n_words == 12
    assert leak(spark, docs, [(1, "too short"), (2, None)]).count() == 0
    assert leak(spark, []).count() == 0
    assert leak(spark, docs, [(1, ITEM), (2, ITEM + " Tail")]).where("doc_id = 1").count() == 2
    assert sorted(r.doc_id for r in leak(spark, docs, [(1, ITEM), (2, "other words " * 20)], shard_words=5).where("item_id = 1").collect()) == [1, 2, 6, 7, 9, 9]


def test_leakage_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(4)]
    items = [(i, " ".join(rng.choice(vocabulary, 16))) for i in range(6)]
    docs = [(i, " ".join(rng.choice(vocabulary, 300)), 0) for i in range(30)]
    expected = set()
    for d, t, _ in docs:
        for i, x in items:
            xs = x.split()
            if any(f" {' '.join(xs[k : k + 5])} " in f" {t} " for k in range(12)):
                expected.add((d, i))
    assert {(r.doc_id, r.item_id) for r in leak(spark, docs, items, min_words=5).collect()} == expected


# -- packing -----------------------------------------------------------------------------------
@given(st.integers(0, 60), st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6))
@settings(max_examples=100, deadline=None)
def test_best_filling_is_best(window, counts):
    got = best_filling(window, sorted(counts, reverse=True), counts)
    assert all(0 < k <= counts[n] for n, k in got.items())
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= window}
    assert sum(n * k for n, k in got.items()) == max(sums)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
@settings(max_examples=50, deadline=None)
def test_containers_hold(lengths):
    sizes = np.array(lengths)
    box = minimum_bin_slack(sizes, 100)
    used = np.bincount(box, weights=sizes)
    assert (used <= 100).all() and (used > 0).all()
    assert len(used) <= 2 * sum(lengths) / 100 + 1


@needs_tokenizer
def test_packing(spark):
    rng = np.random.default_rng(0)
    docs = [(i, "word " * int(n), 9) for i, n in enumerate(rng.integers(1, 400, 300))] + [(1000, None, 9), (1001, " \n", 9), (1002, "long text " * 3000, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, piece int")
    limits = spark.createDataFrame([(1, 512), (2, 2048), (3, None), (4, 0)], "limit_id long, capacity_tokens long")
    placed = pack(df, limits)
    sizes = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    for limit, capacity in ((1, 512), (2, 2048)):
        rows = placed.where(f"limit_id = {limit}").collect()
        per, fill = {}, {}
        for r in rows:
            per.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
            if r.container is None:
                assert sizes[r.doc_id] == 0
            else:
                fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        for doc, size in sizes.items():
            at = 0
            for start, n in sorted(per[doc]):
                assert start == at
                at += n
            assert at == size and (len(per[doc]) == 1 or size > capacity)
    rates = {r.limit_id: r.unused_share for r in fill_rate(placed).collect()}
    assert set(rates) == {1, 2} and max(rates.values()) < 0.03
    assert pack(df.limit(0), limits).count() == 0 and pack(df, limits.limit(0)).count() == 0


# -- residue -----------------------------------------------------------------------------------
RESIDUE = [
    "{{ title }}", "Dear ${name}, your order {{order_id}} has shipped.", "Summary of &lt;BODY&gt;", "Hello null, the page undefined has null rows.", "Total: NaN - Owner: undefined", "[TBD] [TBD] - replace before publishing", "TODO: write this section",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf asdf qwer asdf", "text text text text text", "Sample text goes here. Sample text goes here.", "xxxxx xxxxx", "Your content here. Replace this paragraph with your own words.",
    "404 Not Found", "HTTP 503", "Error 502 (bad gateway) - try again later", "503 Unavailable An unexpected condition stopped the page. [retry]", "Oops! Something went wrong on our side. Go back or try later.", "The page you requested could not be found.",
    "Please enable JavaScript to view this page.", "JAVASCRIPT IS DISABLED IN YOUR BROWSER. ENABLE IT AND RELOAD.", "To read this article, switch on client-side scripts.", "<div>This&nbsp;site requires cookies and Java Script.</div>", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Seite nicht gefunden. Bitte prüfen Sie die Adresse.",
]
CONTENT = [
    "The console draws its charts with JavaScript, but the store can be queried without it.", 'Le message "Veuillez activer JavaScript" vient du portail.', "Our loader fills the template {{ table }} with the real name before it sends the statement to the node.",
    'Log excerpt: "Error 502: bad gateway" appeared 12 times while the writer was idle.', "For the load test we stored lorem ipsum strings of 3 bytes in a column.", "Please enable JavaScript in the admin viewer if you want live counters; nothing else needs it.",
    "The row reader returns undefined order for range scans, and that is stated in the manual.", "A TODO in the source says that the index must be rebuilt.", "select * from t where a = ? and b > ?", "> 404 Not Found", "Menu", "", "404 rows were read in 503 ms.", "Otherwise a null bitmap replaces a null bitmap.", "None of the two null rows was read.", "Keys named asdf and test belong to the test runner and may be deleted.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_lines(text):
    assert any(is_residue(x) for x in lines(text)), clean(text)


@pytest.mark.parametrize("text", CONTENT)
def test_content_lines(text):
    assert not any(is_residue(x) for x in lines(text))


# wordings that no list of the module was read against
HELD_OUT = """
You'll need to switch on JavaScript before we can display the catalogue.
Scripting has been turned off; nothing can be displayed.
Hello [FIRST_NAME], thanks for contacting [COMPANY].
Insert chapter text here
Origin unreachable (521)
Страница не найдена
We're sorry, but our site doesn't work properly without JavaScript enabled.
This application requires scripts. Please allow them and reload.
Your browser has JavaScript turned off.
JavaScript must be switched on to load this document.
Scripts are blocked; please permit them to continue.
Cookies are disabled. Please enable cookies in your browser.
Per visualizzare questa pagina, attivare JavaScript nel browser
Para ver esta página, habilite JavaScript en su navegador.
Bitte schalten Sie JavaScript in Ihrem Browser ein, um die Seite zu laden.
Sorry, the page you were looking for doesn't exist.
The requested URL was not found on this server.
Sorry, this content isn't available right now
HTTP ERROR 500
502 Bad Gateway
This site can't be reached
The connection has timed out
The server is temporarily unable to service your request. Please try again later.
Your session has expired, please log in again.
We are down for maintenance. Please check back soon.
You don't have permission to access this resource.
Access to this page has been denied.
Too many requests, please wait a few minutes.
The upstream server returned an invalid response.
Diese Seite ist leider nicht verfügbar.
La page demandée est introuvable.
La página que busca no existe.
Pagina non trovata
Service currently offline, please retry shortly.
Internal server error: the request failed.
The link you followed may be broken, or the page may have been removed.
Write your introduction here
Add a description here
Replace this placeholder text before publishing.
[Company_Name] welcomes you, [Customer_Name]
Dear %%FIRSTNAME%%, your order %%ORDER%% is ready.
Hi {{user.first_name}}, welcome to {{ site.name }}
<%= title %>
Placeholder paragraph. Enter your text.
This is sample text. Edit this paragraph to add your own.
TODO: fill in summary
Your headline goes here
lorem ipsum dolor sit amet
Title of ${page.title}
Dummy content, to be replaced by the writer.
""".strip().splitlines()
HELD_OUT_CONTENT = """
The viewer needs JavaScript 1.8 or later, which is why the console of 2019 fails on old terminals.
We replaced the placeholder in the template with the table name during the build.
When the server returns 503 the client waits and sends the batch to another replica.
A page that is not found in the cache is read from the segment file.
The request failed because the writer had been stopped for compaction.
Errors in the summary file are reported by the loader with the segment number.
The text of the paragraph describes how the range index works.
You can add a description to every column of the table.
Our users asked why the error page of the portal appears after each upgrade of the index.
The script loads ten million keys and prints the throughput.
Pages are flushed when the memory table is full.
Timeouts on the second node were caused by a slow disk.
The session expired while the import of the orders was running, so the rows were lost.
Enable the summary option before you load the segments.
Not every key exists in every segment.
Sample rows of the table follow.
The title column is required and must not be null.
The connection pool of the gateway holds 20 sessions.
If a document is removed, its vectors are removed as well.
The heading names the keyspace and the text below explains the columns.
""".strip().splitlines()


def test_held_out_wordings():
    found = [t for t in HELD_OUT if any(is_residue(x) for x in lines(t))]
    assert len(found) >= 0.8 * len(HELD_OUT) and len(HELD_OUT) >= 40
    assert not [t for t in HELD_OUT_CONTENT if any(is_residue(x) for x in lines(t))]


def test_signs_and_titles(spark):
    docs = [(1, "{{ title }}", "a"), (2, "Please enable JavaScript to view this page.", "a"), (3, "404 Not Found", None), (4, "Something real.", "b"), (5, "Catalogue errors\n\nThe catalogue page was not found.", "b")]
    got = {r.doc_id: r.sign for r in residue_signs(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {1: "placeholder", 2: "script", 3: "error"}  # 5 takes up its title


def test_residue_documents(spark):
    docs = [(i, t, "h", None) for i, t in enumerate(RESIDUE)] + [(100 + i, t, None, 1) for i, t in enumerate(CONTENT)]
    docs += [(200, None, "h", 1), (201, " \n ", "h", 1), (202, "Real words.\n\n" + "more of them. " * 5000 + "\n\n404 Not Found\n\nend", None, 1), (203, "```\n404 Not Found\n```\nhow it looks", "h", 1), (203, RESIDUE[0], "h", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, line int")
    assert sorted(r.doc_id for r in residue_documents(df).collect()) == [*range(len(RESIDUE)), 202, 203]
    assert residue_documents(df.limit(0)).count() == 0


def test_host_evidence_finds_unknown_wordings(spark):
    notice = "whatever you came for, our server has denied the visit"
    docs = [(i, f"Report number {chr(97 + i % 26)}{chr(97 + i // 26)} about grain\n\n{notice}", f"host{i % 7}") for i in range(60)]
    docs += [(100 + i, f"Only here {chr(97 + i)}\n\nthe server has denied us the visit to the old barn today", "host1") for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in residue_documents(df).collect()) == list(range(60))


def test_host_evidence_finds_texts_of_one_line(spark):
    notice = "whatever you came for, our server has denied the visit"
    docs = [(i, notice, f"host{i % 7}") for i in range(30)]
    docs += [(100 + i, "the server has denied us the visit to the old barn today", "host1") for i in range(30)]  # one host
    docs += [(200 + i, "the request went to the server", f"host{i}") for i in range(2)]  # few documents
    long = "a report about grain and barley and oats and rye and wheat and the weather of the year in "
    docs += [(300 + i, f"{long} {chr(97 + i)}\n\nno visit: the server has denied what you came for", f"host{i % 7}") for i in range(26)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in residue_documents(df).collect()) == [*range(30), *range(300, 326)]
