"""Personal data, urls, languages and pages against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stockaudit.llm import html_regions, language_zstd, pii_boosting, queries, url_boosting
from stockaudit.llm.tables import read

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    None, "", "a@b.c_d@e.f", "x..y@z..q@r.s", "a@b.c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111-1111 1111",
    "4111111111111111" * 2, "4111  1111 1111 1111", "+1 (650) 555-0000.", "+49 30 1234567 +1", "é@x.de +12345678é 😀 q@w.eu",
    "9" * 5000, "a." * 3000 + "@x.y" + ".z" * 3000, "1 2 " * 4000, "@" * 50, "\ue001a@b\ue001c.d", "jo (at) ex (dot) org",
]


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def check_personal_data(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert set(joined) <= set(r.spans.split(","))


def test_personal_data_of_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    rows = queries.queries()["op8_pii_boosting"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_personal_data(rows, texts)


def test_personal_data_of_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    check_personal_data(pii_boosting.digests(docs).collect(), dict(enumerate(HARD)))


def test_spelled_addresses_and_national_numbers_are_added(spark):
    def luhn_card(n):
        return next(c for c in (f"4111 1111 {n:04d} {k:04d}" for k in range(10)) if valid("card", c))

    texts = [f"Mail ann{i}@site{i % 7}.org or call +49 {30 + i % 9} {1234567 + i}, paid by {luhn_card(i)}" for i in range(120)]
    texts += [f"We sold {12345678 + 11 * i} of {1 + i % 9} 000 {100 + i} pieces on 2021-03-{10 + i % 20}, card 4111 1111 1111 {1000 + i}" for i in range(120)]
    planted = {"email": "jo (at) ex (dot) org", "phone": "030 1234567", "card": "4111.1111.1111.1111"}
    first = len(texts)
    texts += [f"Mail {planted['email']} or call {planted['phone']}, paid by {planted['card']}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii_boosting.digests(docs).collect()}
    check_personal_data(rows.values(), dict(enumerate(texts)))
    want = [f"{k}:{texts[first].index(m)}:{texts[first].index(m) + len(m)}" for k, m in planted.items()]
    assert sorted(rows[first].spans.split(",")) == sorted(want)
    for d in range(120, 240):
        assert rows[d].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[d])), (texts[d], rows[d].spans)


def test_personal_data_is_learned_from_all_rows(spark, monkeypatch):
    """Trees weigh every distinct base form, of which there are more than any bounded sample held."""
    docs = spark.range(16_000).selectExpr("id AS doc_id", "concat('call +49 30 ', id + 1000000, ' or 12', id) AS text")
    seen = []
    monkeypatch.setattr(pii_boosting.boosting, "fit", lambda rows, features, label, *weight: seen.append((rows, *weight)))
    pii_boosting.digests(docs).count()
    (rows, weight), = seen
    learned = rows.where("kind = 'phone' AND label = 1").agg(F.sum(weight)).first()[0]
    assert 11_000 < learned < 13_000  # three of four


def test_redaction(spark):
    rows = [(1, "mail a@b.cd or +1 (650) 555-0000!", "x"), (2, None, "y"), (3, "none", "z"), (3, "none", "z")]
    out = pii_boosting.redact(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()
    assert sorted((r.doc_id, r.text or "", r.kind) for r in out) == [(1, "mail [email] or [phone]!", "x"), (2, "", "y"), (3, "none", "z"), (3, "none", "z")]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [r for r in url_boosting.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def check_urls(rows, urls):
    for r in rows:
        host, path = parsed(urls[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_urls_of_pages(spark, sf_dir):
    urls = {r.page_id: r.url for r in read(spark, sf_dir, "pages").collect()}
    rows = queries.queries()["op6_url_boosting"](spark, sf_dir).collect()
    assert len(rows) == len(urls)
    check_urls(rows, urls)


def test_odd_urls(spark):
    odd = [None, "", "net/", "http://net", "http://NET/x", "a://b://c.net/?q#f", "https://x.example.net/en/1", "https://xexample.net/en/", "s://org/fr/", "://É.ORG/fr/a#b?c"]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string").withColumn("length", F.lit(1))
    check_urls(url_boosting.judge(pages).collect(), dict(enumerate(odd)))
    assert url_boosting.judge(pages.limit(0)).count() == 0


def test_trees_judge_held_back_urls(spark):
    """Ruled urls that are kept from learning: what the trees say of them, against their rules."""
    judged = url_boosting.ruled(read(spark, "/root/testdata/sf0.1", "pages").dropDuplicates(["url"]))
    kept_back = F.pmod(F.xxhash64("_u"), F.lit(4)) == 0
    learned = url_boosting.learn(judged.where(~kept_back))
    rows = url_boosting.scored(judged.where(kept_back & F.col("_verdict").isNotNull()), learned, "score").collect()
    right = [(r.score > 0.5) == (r._verdict == "block") for r in rows]
    assert len(rows) > 20 and sum(right) >= 0.9 * len(rows)


def test_a_url_counts_once_in_what_is_learned(spark):
    rows = [(i, f"http://a{i % 40}.net/x/{i}") for i in range(300)] + [(i, f"http://b{i % 40}.org/fr/{i}") for i in range(300)]
    copies = [(1000 + i, "http://a1.net/x/1") for i in range(12_000)]
    schema = "page_id long, url string"
    once, many = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + copies, schema)
    odd = spark.createDataFrame([(-i, f"http://{'a' if i % 2 else 'c'}{i}.{'net' if i % 3 else 'com'}/y?z={i}") for i in range(1, 40)], schema)
    judged = [{r.page_id: r.block_score for r in url_boosting.judge(pages.unionByName(odd)).where("page_id < 0").collect()} for pages in (once, many)]
    assert judged[0] == judged[1]
    learned = url_boosting.learn(url_boosting.ruled(many))
    assert learned.model is not None and learned.counts.agg(F.sum("n")).first()[0] == 3 * 600


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "s string").select(url_boosting.entropy(F.col("s")).alias("e")).collect()
    assert [r.e for r in got] == pytest.approx([1.0, 0.0, 2.0])


def test_languages_held_out(spark, sf_dir):
    truth = {r.doc_id: r for r in read(spark, sf_dir, "documents").collect()}
    rows = queries.queries()["op7_language_zstd"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and truth[r.doc_id].lang]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in judged) >= 0.9 * len(judged)
    assert sum(r.rejected for r in rows) <= 0.05 * len(rows)


def test_odd_languages(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en", "c") for i in range(40)] + [(i, "der hund und die katze auf der matte " * 3, "de", "c") for i in range(40, 80)]
    docs = spark.createDataFrame([*rows, (90, None, "en", "c"), (91, "12 !?", "en", "c"), (None, "the cat and the dog", None, None)], schema)
    found = {r.doc_id: r for r in language_zstd.identify(docs).collect()}
    assert [found[k].lang_pred for k in (90, 91, 0, 79)] == ["und", "und", "en", "de"] and found[None].lang_pred == "en"
    kept = language_zstd.keep_identified(docs)
    assert kept.columns == docs.columns and {90, 91}.isdisjoint(r.doc_id for r in kept.collect())
    assert {r.lang_pred for r in language_zstd.identify(docs.where("lang IS NULL")).collect()} == {"und"}


def plain_language(text, learned):
    """The language whose dictionary shortens the text most, worked out segment by segment without batches."""
    import zstandard

    raw = " ".join(re.findall(r"[^\W\d_]+", text.lower())) if text else ""
    sizes = {}
    for lang, content in learned.dictionaries.items():
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made = zstandard.ZstdCompressor(level=language_zstd.LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)
        data, step = raw.encode(), language_zstd.SEGMENT_BYTES
        sizes[lang] = sum(len(made.compress(data[i : i + step])) for i in range(0, len(data), step))
    return min(sizes, key=lambda k: (sizes[k], k)) if raw else "und"


def test_languages_against_a_plain_version(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    learned = language_zstd.learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r.lang_pred for r in language_zstd.identify(docs).collect()}
    # Letters at the ends leave a space in batches, which may decide between near totals.
    assert sum(found[k] == plain_language(t, learned) for k, t in texts.items()) >= 0.98 * len(texts)


def test_noise_is_rejected_and_text_is_kept(spark):
    draw = random.Random(2)
    noise = [" ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n)) for n in (30, 100, 400) for _ in range(60)]
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    rows = language_zstd.identify(docs.unionByName(more)).collect()
    assert sum(r.rejected for r in rows if r.doc_id >= 10**6) >= 0.98 * len(noise)
    long = {r.doc_id for r in docs.where("lang IS NOT NULL AND length(text) > 200").collect()}
    assert sum(not r.rejected for r in rows if r.doc_id in long) >= 0.99 * len(long)


def test_odd_language_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    rows = [(1, "the cat " * 100_000, "en", "x"), (1, "the cat " * 100_000, "en", "x"), (None, None, None, "x"), (2, "", "de", "x")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r.lang_pred for r in language_zstd.identify(docs).collect())) == ["en", "en", "und", "und"]
    assert language_zstd.identify(docs.limit(0)).collect() == [] and language_zstd.keep_identified(docs.limit(0)).columns == docs.columns


def test_redaction_of_any_column_names(spark):
    rows = [(7, "mail a@b.cc now", "x", "y", "z", "k", 3), (7, None, "x", "y", "z", "k", 3)]
    schema = "doc_id long, text string, base string, added string, all_spans string, row string, n_chars int"
    docs = spark.createDataFrame(rows, schema)
    got = pii_boosting.redact(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(7, "mail [email] now", "x", "y", "z", "k", 16), (7, None, "x", "y", "z", "k", None)], key=repr)
    assert pii_boosting.redact(docs.limit(0)).collect() == []


def test_article_of_pages(spark, sf_dir):
    import html

    for r in queries.queries()["op9_html_regions"](spark, sf_dir).join(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*?)(?:</article>|<footer>|$)", r.html or "", re.S)
        blocks = re.split("</?(?:p|h1)>", re.sub("<br>|</?b>", " ", body[1])) if body else []
        assert r.text == "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<header>Site</header><main><h1>T</h1><p>x<script>a<b</script> y<form>f</form><ul><li>one<li>two</ul></main><aside>s</aside>", "T\n\nx y\n\none\n\ntwo"),
    ("<article><p>a<br>b<div class='comments'><p>nice</div><p>c</article><div id=cookie-notice>ok</div>", "a b\n\nc"),
])
def test_main_text(page, want):
    assert html_regions.extract(page) == want


BODY = "<h1>Title</h1><p>First long paragraph of the text, with words.</p><p>Second long paragraph of the text, with words.</p>"
BODY_TEXT = "Title\n\nFirst long paragraph of the text, with words.\n\nSecond long paragraph of the text, with words."
COMMENTS = "<div id='comments' class='comments-area'><ol class='comment-list'><li><article class='comment'><p>nice</article></ol></div>"


@pytest.mark.parametrize("page, want", [
    (f"<article class='post has-comments'>{BODY}</article>", BODY_TEXT),
    (f"<div id='page' class='no-sidebar'><article>{BODY}</article></div>", BODY_TEXT),
    (f"<div class='content with-sidebar'>{BODY}</div>", BODY_TEXT),
    (f"<article><div class='article-header'><h1>T</h1></div>{BODY}</article>", f"T\n\n{BODY_TEXT}"),
    (f"<article class='sponsored'>{BODY}</article>", BODY_TEXT),
    (f"<div class='widget'><div class='menu'>Home</div><main>{BODY}{COMMENTS}</main></div>", BODY_TEXT),
    (f"<div class='site_header'>Site</div><div class='widget'>{BODY}</div>{COMMENTS}", BODY_TEXT),
    (f"<div class='sidebar'><article>teaser</article></div><article>{BODY}<span class='ad'>buy</span></article>", BODY_TEXT),
    (f"<div class='site-header'><h1>Site</h1></div><div>{BODY}</div><div class='related-posts'>more</div>{COMMENTS}", BODY_TEXT),
])
def test_names_leave_out_whole_tokens_and_no_article(page, want):
    assert html_regions.extract(page) == want


LONG = "Long paragraph of the text, with many words in it, and one more. "
LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in "one two three four five six".split())


def unnamed(page):
    """The page with all elements that tell the article or its surroundings made divs without names."""
    page = re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside)\b[^>]*>", r"<\1div>", page)
    return re.sub(r" (?:class|id|role)=('[^']*'|\"[^\"]*\")", "", page)


def test_clusters_select_the_region():
    """No element or name tells the article; ratios do, and a threshold that all lines pass gives another result."""
    page = f"<html><body><div><ul>{LINKS}</ul></div><div><h2>T</h2><p>{LONG * 9}</p><p>short</p><p>{LONG * 9}</p></div><div><b>c</b> x</div></body></html>"
    want = f"T\n\n{(LONG * 9).strip()}\n\nshort\n\n{(LONG * 9).strip()}"
    assert html_regions.extract(page) == want
    assert html_regions.extract(page.replace("<div><h2>", "<article><h2>").replace("</p></div>", "</p></article>")) == want
    links = page.replace(LONG * 9, LONG * 2).replace(LINKS, LINKS * 20)
    assert html_regions.extract(links, threshold=-1e9) != html_regions.extract(links)
    lines = [html_regions.Line("x" * n, 1, 0, False) for n in (3, 4, 900, 5, 900, 800, 3, 2)]
    assert html_regions.clusters(lines).tolist() == [False, False, True, False, True, True, False, False]
    assert html_regions.clusters(lines, threshold=-1e9).all()


def test_pages_without_article_elements_and_without_any_names(spark, sf_dir):
    pages = [(r.html or "", html_regions.extract(r.html)) for r in read(spark, sf_dir, "pages").collect()]
    renamed = [re.sub(r"<(/?)article", r"<\1div", html) for html, _ in pages]
    assert [html_regions.extract(html) for html in renamed] == [text for _, text in pages]
    found = [html_regions.extract(unnamed(html)) for html, _ in pages]
    assert sum(a == text for a, (_, text) in zip(found, pages)) >= 0.75 * len(pages)
    everything = [html_regions.extract(unnamed(html), threshold=-1e9) for html, _ in pages]
    assert sum(a == text for a, (_, text) in zip(everything, pages)) < 0.1 * len(pages)


def test_surroundings_of_the_region():
    body = f"<p>{LONG * 3}</p>"
    # A heading and a lead before the innermost container, within the one around it.
    assert html_regions.extract(f"<div><ul>{LINKS}</ul></div><div><h1>T</h1><p>{LONG * 2}</p><div>{body * 6}</div></div>").startswith(f"T\n\n{(LONG * 2).strip()}\n\n")
    # Two articles are both content, the line between them is not.
    two = f"<body><article>{body}</article><div>x</div><article>{body}</article></body>"
    assert html_regions.extract(two) == "\n\n".join([(LONG * 3).strip()] * 2)


@pytest.mark.parametrize("page", [
    "<div class='menu'>{}</div>", "<div class='widget'>{}</div><h1>t</h1>", "<b>{}</i>", "<p>{}<div>", "<article>{}", "<table><tr><td>{}",
])
def test_nested_elements_cost_linear_time(page):
    import time

    first, last = page.split("{}")
    spent = []
    for n in (2000, 40_000):
        start = time.process_time()
        html_regions.extract(first * n + "x" + last * n)
        spent.append(time.process_time() - start)
    assert spent[1] < 60 * spent[0] + 1


def test_odd_pages(spark):
    long = f"<article><p>{LONG * 20_000}</p></article>"
    rows = [(1, "u", long, 0, "t"), (1, "u", long, 0, "t"), (None, None, None, 0, "t"), (2, "v", "", 0, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_regions.main_texts(pages).collect()), key=repr)
    text = (LONG * 20_000).strip()
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_regions.main_texts(pages.limit(0)).collect() == []
