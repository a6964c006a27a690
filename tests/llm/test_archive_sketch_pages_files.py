from __future__ import annotations

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from moundwork.llm import huffman, page_diff, queries, sketches, token_files, warc

RECORDS = "record_id long, kind string, url string, captured_at timestamp, status int, headers map<string,string>, digest string, payload string"


def resolve(spark, rows, **options):
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, at string, status int, headers map<string,string>, digest string, payload string")
    frame = frame.withColumn("captured_at", F.to_timestamp("at")).drop("at")
    return {r.record_id: r for r in warc.resolve_revisits(frame, **options).collect()}


def test_revisits_take_the_latest_earlier_response(spark):
    day = "2024-01-{:02d} 10:00:00".format
    rows = [
        (1, "response", "http://www.A.com:80/x/#f", day(1), 200, {"ETag": '"a"', "Content-Length": "3", "X": "1"}, "d1", "one"),
        (2, "response", "https://a.com/x", day(3), 200, {"etag": '"b"'}, "d2", "two"),
        (3, "response", "https://a.com/x", day(4), 404, {"etag": '"c"'}, "d3", "no"),
        (4, "revisit", "http://a.com/x", day(2), 304, {"ETag": 'W/"a"', "content-length": "0", "x": "2", "Date": "now"}, None, None),
        (5, "revisit", "https://a.com/x/", day(9), 304, {"ETag": '"b"'}, None, None),
        (6, "revisit", "https://a.com/x", day(9), 304, {"ETag": '"a"'}, None, None),
        (7, "revisit", "https://a.com/x", "2023-12-31 00:00:00", 304, {}, None, None),
        (8, "revisit", None, day(9), 304, None, None, None), (9, "revisit", "https://a.com/x", None, 304, None, None, None),
        (10, "revisit", "https://a.com/x", day(3), 304, None, "d2", None), (11, "revisit", "https://a.com/x", day(3), 304, None, "other", None),
    ]
    for seconds in (1, 86_400, 10**9):
        got = resolve(spark, rows, slice_seconds=seconds)
        assert {k: (r.verdict, r.refers_to) for k, r in got.items()} == {
            4: ("resolved", 1), 5: ("resolved", 2), 6: ("validator mismatch", None), 7: ("no earlier response", None),
            8: ("no earlier response", None), 9: ("no earlier response", None), 10: ("resolved", 2), 11: ("validator mismatch", None)}
        assert got[4].headers == {"etag": 'W/"a"', "content-length": "3", "x": "2", "date": "now"} and got[4].payload == "one"
        assert got[6].headers is None and got[6].payload is None
    assert resolve(spark, rows[:0] or [r for r in rows if r[0] == 1]) == {}


def test_revisits_of_one_busy_url_equal_a_plain_join(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["response", "revisit", "revisit"]), f"http://h{rng.choice([0, 0, 0, 1])}.org/", f"2024-02-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", 200, {}, None, str(i)) for i in range(400)]
    got = resolve(spark, rows)
    for i, kind, url, at, *_ in rows:
        if kind == "revisit":
            earlier = [(t, k) for k, kd, u, t, *_ in rows if kd == "response" and u == url and t <= at]
            assert got[i].refers_to == (max(earlier)[1] if earlier else None)


def test_op7_query(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op7_warc_revisits(spark, folder).collect()
    assert len(rows) == 3 * len(pages)
    for r in rows:
        page, n = divmod(r.record_id, 4)
        if n == 3:
            assert r.verdict == "validator mismatch"
        elif r.verdict == "resolved":
            assert r.refers_to == 4 * page and r.n_chars == len(pages[page].html)
        else:
            assert n == 1 and page % 7 == 0


def test_op7_query_equals_check_sql(spark, folder):
    from parity import compare, open_views

    frame = queries.op7_warc_revisits(spark, folder)
    cursor = open_views(folder).execute(queries.ORACLES["op7_warc_revisits"])
    names = [d[0] for d in cursor.description]
    problem, _ = compare([tuple(r) for r in frame.collect()], frame.columns, cursor.fetchall(), names)
    assert problem is None, problem


def shingles(text, words=5):
    """Leading 32 bits of the hash of every run of words, by the words of the text alone."""
    parts = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", parts)
    runs = [parts[i:i + words] for i in range(max(1, len(parts) - words + 1))] if parts else []
    return {xxhash.xxh64_intdigest(" ".join(run).encode(), 42) >> 32 for run in runs}


def plain_sketch(text, share=sketches.SHARE):
    return sorted(h for h in shingles(text) if h / 2**32 < share)


def plain_likeness(a, b):
    a, b = set(plain_sketch(a)), set(plain_sketch(b))
    return len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)


@pytest.mark.parametrize("share", [1 / 16, 1 / 4, sketches.SHARE, 1.0])
def test_sketches_estimate_containment_and_merge(share):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))
    part = " ".join(long.split()[1000:1600])
    a, b = sketches.sketch(long, share=share), sketches.sketch(part, share=share)
    assert sketches.containment(a, b) == 1.0 and len(a) == pytest.approx(4000 * share, rel=0.15)
    assert list(a) == plain_sketch(long, share) and list(sketches.read(sketches.write(a))) == list(a)
    empty = sketches.sketch("")
    assert sketches.containment(empty, empty) == 1.0 and sketches.containment(empty, a) == 0.0


def test_merged_sketches_are_those_of_all_shingles():
    rng = random.Random(5)
    for _ in range(300):
        texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 5, 6, 9, 400]))) for _ in range(3)]
        merged = sketches.sketch(None)
        for text in texts:
            merged = sketches.merge(merged, sketches.sketch(text))
        assert list(merged) == sorted(set().union(*map(plain_sketch, texts)))


@pytest.mark.parametrize("words,least", [(5, 0.9), (6, 0.97), (10, 0.999), (100, 1.0)])
def test_short_texts_are_found_in_long_ones(words, least):
    rng = random.Random(words)
    found = []
    for _ in range(400):
        long = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        at = rng.randrange(3000 - words)
        found.append(sketches.containment(sketches.sketch(" ".join(long)), sketches.sketch(" ".join(long[at:at + words]))))
    assert sum(found) / len(found) >= least


@pytest.mark.parametrize("per_range", [7, 10_000])
def test_next_documents(spark, docs_of, monkeypatch, per_range):
    monkeypatch.setattr(sketches, "ROWS_PER_RANGE", per_range)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "A b " * 20_000]
    keys = rng.sample(range(1000), len(texts))
    rows = {r.doc_id: r for r in sketches.compare_with_next(docs_of([(k, t, "en", "s") for k, t in zip(keys, texts)], extra=("range", "guest", "key"))).collect()}
    order = sorted(zip(keys, texts), reverse=True)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        r = rows[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [sketches.read(f).tolist() for f in (r.fingerprint, r.edited_fingerprint)] == [plain_sketch(text), plain_sketch(edited)]
        assert (r.near_edited, r.near_next) == (plain_likeness(text, edited), plain_likeness(text, after))


def test_next_documents_edges(docs_of):
    assert sketches.compare_with_next(docs_of([(1, "a b c", "en", "s")])).first().near_next == 1.0
    assert sketches.compare_with_next(docs_of([(None, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "s"), (3, "x", "en", "s"), (3, "y", "en", "s")])).count() == 4
    assert sketches.compare_with_next(docs_of([(1, "a", "en", "s")]).where("false")).count() == 0


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.choice("abcde") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcdx") for _ in range(rng.randrange(14))]
        places = page_diff.common_places(a, b)
        kept, rest = [a[i] for i in places], iter(b)
        assert places == sorted(set(places)) and len(kept) == plain_lcs(a, b) and all(x in rest for x in kept)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Top</header>
<div class='cookie-notice'>Cookies</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two<br>three</p><ul><li>x<li>y</ul>
<script>var a = "</p>";</script><div class="ad">Buy</div><section id=comments><p>Nice!</section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    lines = page_diff.blocks(PAGE)
    assert page_diff.main_text(lines, ["One two", "x"]) == "Head & more\nOne two\nthree\nx\ny"
    assert page_diff.blocks(None) == [] and page_diff.blocks("<p class='ad'>a<p>b<div hidden>c</div>d &lt;e&gt;") == [("b", False), ("d <e>", False)]
    assert page_diff.blocks("plain <b>text") == [("plain text", False)]
    page_diff.blocks("<a title=\"x>" * 3000)


@pytest.mark.parametrize("per_range", [3, 1000])
def test_shared_lines_go_where_no_article_is_marked(spark, monkeypatch, per_range):
    monkeypatch.setattr(page_diff, "ROWS_PER_RANGE", per_range)
    pages = [(i, f"http://host{i % 3}.org/p/{i:03d}", f"<div>Site name</div><div>text {i}</div><div>Legal line</div>") for i in range(40)]
    pages += [(90, "http://alone.org/", "<p>Only page</p>"), (91, None, None), (92, "http://host0.org/a", PAGE)]
    got = {r.page_id: r for r in page_diff.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(got[i].text == f"text {i}" for i in range(40) if i % 3 != 0 or i > 0)
    assert got[90].text == "Only page" and (got[91].text, got[91].n_chars) == ("", 0) and got[92].text.startswith("Head & more")


def test_an_article_puts_lines_back_and_hides_none_outside():
    lines = page_diff.blocks("<div>Site name</div><main><p>Long story</p></main><article><p>Teaser</p></article><div>Legal line</div>")
    assert page_diff.main_text(lines, ["Site name", "Other story", "Teaser", "Legal line"]) == "Long story\nTeaser"
    assert page_diff.main_text(lines, None) == "Site name\nLong story\nTeaser\nLegal line"


def test_attributes_are_whole_pairs():
    for plain in (' href="/travel/hidden-gems"', ' title="the hidden cost"', ' data-hidden="false"', ' data-id="related"', " alt='role=menu'", " href=/a/hidden"):
        assert not page_diff._left_out("a", plain, True), plain
    for marked in (" hidden", ' href="/x" HIDDEN=""', ' title="a b" aria-hidden = true', " id='related'", ' style="display: none"', " role=menu"):
        assert page_diff._left_out("a", marked, True), marked
    assert page_diff.blocks('<article><p>See <a href="/hidden-gems">these places</a>.</article>') == [("See these places.", True)]


@pytest.mark.parametrize("part", [
    '<p class="share price">', '<p class="related-work">', '<p id="comments-on-the-law">', '<section class="widget">', '<p class="ad-hoc">',
    '<p class="search results">', '<div id="social-history">', '<p class="notices-of-1848">', '<div class="banner">', '<p class="reply-rate">'])
def test_names_of_subjects_hide_no_article_text(part):
    assert page_diff.blocks(f"<article>{part}Shares rose</article>") == [("Shares rose", True)]


@pytest.mark.parametrize("part", [
    '<div class="ad">', '<div class="box advert">', "<section id=comments>", '<div class="notice">', '<ul class="menu">', '<div class="Sidebar left">',
    '<div class="cookie-notice">', "<form>", "<aside>", "<nav>", '<div role="complementary">'])
def test_furniture_in_an_article_goes(part):
    assert page_diff.blocks(f"<article><p>Text</p>{part}Furniture</article>") == [("Text", True)]


class Article(HTMLParser):
    """Block texts of the article elements, without the elements that are no text of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.lines, self.held = [], [], []

    def cut(self):
        text = " ".join("".join(self.held).split())
        self.lines += [text] if text else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in page_diff.BLOCKS:
            self.cut()
        if tag in page_diff.VOID or tag in ("p", "li"):  # the pages close neither reliably, and neither holds furniture
            return
        gone = tag in ("nav", "aside", "footer", "form", "script", "style") or dict(attrs).get("class") in ("ad", "comments", "cookie-notice")
        self.stack.append((tag, gone))

    def handle_endtag(self, tag):
        if tag in page_diff.BLOCKS:
            self.cut()
        if any(tag == t for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(gone for _, gone in self.stack):
            self.held.append(data)


def article_text(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.cut()
    return "\n".join(parser.lines)


def test_op9_query(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op9_page_diff(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article_text(pages[r.page_id].html), len(r.text))


def test_page_edges(spark):
    schema = "page_id long, url string, html string, range int, guest boolean, `order` string, host string, lines string"
    extra = (7, True, "o", "h", "l")
    long = "<article>" + "".join(f"<p>Line {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a.org/1", long), (1, "http://a.org/1", long), (None, "http://a.org/2", "<p>No id"), (None, "http://a.org/2", "<p>No id"),
            (4, "", ""), (5, "not a url", "<p>Some text"), (6, "http://b.org", None)]
    frame = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in page_diff.extract(frame).collect()), key=str)
    text = "\n".join(f"Line {i}" for i in range(20_000))
    assert [g for g in got if g[0] == 1] == [(1, "http://a.org/1", text, len(text))] * 2
    assert len(got) == 7 and all(n == len(t) for _, _, t, n in got) and (6, "http://b.org", "", 0) in got
    assert page_diff.extract(frame.where("false")).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(2)
    import heapq

    for _ in range(20):
        counts = np.array([rng.choice([0, 1, 5, 100, 10_000]) for _ in range(60)])
        used = counts[counts > 0]
        heap = sorted(used.tolist())
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        lengths = huffman.code_lengths(counts, 40)
        assert (lengths * counts).sum() == cost
        tight = huffman.code_lengths(counts, 7)
        assert tight.max() <= 7 and sum(2.0 ** -tight[tight > 0].astype(float)) == 1.0


def test_round_trip_of_codes():
    rng = np.random.default_rng(1)
    for sizes, width in (([1], 1), ([63, 64, 65], 3), ([1, 1, 200, 1], 40), ([5000, 3], 3000)):
        ids = rng.integers(0, width, sum(sizes)).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids))
        at = 0
        for n, (payload, points) in zip(sizes, huffman.encode(ids, np.array(sizes), huffman.canonical(lengths), lengths)):
            counts = np.full(len(points), huffman.EVERY)
            counts[-1] = n - huffman.EVERY * (len(points) - 1)
            assert (huffman.Decoder(lengths).decode(payload, points, counts) == ids[at:at + n]).all()
            at += n
    assert huffman.encode(ids[:0], np.array([], int), huffman.canonical(lengths), lengths) == []


@pytest.mark.parametrize("block", [50, 500_000])
def test_token_files_round_trip(spark, tmp_path, docs_of, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "ROWS_PER_RANGE", 5)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["some words here", None, "", "long " * 400, "same", "same", "café \U0001F600"] + [f"text {i} of many" for i in range(20)]
    rng = random.Random(3)
    keys = rng.sample(range(500), len(texts))
    token_files.write_token_files(docs_of([(k, t, "en", "s") for k, t in zip(keys, texts)], extra=("part", "planes")), str(tmp_path / "f"), queries.tokenizer_path())
    rows = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "f")).collect()}
    at = 0
    for key, text in sorted(zip(keys, texts)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[key].start, rows[key].n_ids, bytes(rows[key].ids)) == (at, len(ids), ids.tobytes())
        at += len(ids)
    token_files.write_token_files(docs_of([(1, "a", "en", "s")]).where("false"), str(tmp_path / "none"), queries.tokenizer_path())
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_op10_query(spark, folder, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows, at = {r.doc_id: r for r in queries.op10_token_files(spark, folder).collect()}, 0
    for key in sorted(documents):
        ids = np.array([*tokenizer.encode(documents[key].text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[key].start, rows[key].n_tokens, rows[key].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_codes_for_more_ids_than_eighteen_bits_number():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 1000, 300_000)
    counts[:10] = 10**9
    lengths = huffman.code_lengths(counts)
    assert lengths.min() > 0 and np.ldexp(1.0, -lengths.astype(int)).sum() <= 1 + 1e-9
    ids = rng.integers(0, 300_000, 1000).astype(np.int64)
    sizes = np.array([700, 300])
    decoder = huffman.Decoder(lengths)
    parts = huffman.encode(ids, sizes, huffman.canonical(lengths), lengths)
    for (payload, points), own in zip(parts, np.split(ids, [700])):
        left = np.full(len(points), huffman.EVERY)
        left[-1] = len(own) - huffman.EVERY * (len(points) - 1)
        assert decoder.decode(payload, points, left).tolist() == own.tolist()
