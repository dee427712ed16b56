"""Defined results for odd rows, and comparisons with brute force on small tables."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bloom, op1_url_filter, op2_packing, op3_html, op4_embedding_dedup, op5_minhash_dedup, op6_toxicity, op7_token_blocks, op8_warc, op9_quality, op10_decontamination
from docloom.llm.graph import components

SMALL = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use.
CLASH = {"score": 1.0, "label": 5, "n": 2, "key": "k", "sig": "s", "stats": "x", "host": "h", "path": "p", "part": 3, "length": 9, "segment": 1, "items": "i", "node": "q", "kept": False}


def clashing(df):
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASH.items() if k not in df.columns))


def odd_documents(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "One TWO three four five six"), (None, "a null id here with words"), (7, long), (8, "é ünï 中文 \u00a0x <|endoftext|>"), (9, "word%%% " * 50)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (5, 0, 0), (77, 1, 0), (9, None, None)]
    return clashing(spark.createDataFrame(rows, "doc_id long, quality int, toxic int").drop("label"))


def empty(df):
    return df.limit(0)


# --- 1


def judged(spark, urls, rules=op1_url_filter.RULES):
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    out = op1_url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://net/", "https://net", "http://x.net/fr", "http://example.com/de/", "http://notexample.com/de/", "http://b.org/fr/1", "mailto:x", None, "x://h://y/z", "http://EXAMPLE.com:80/de/", "http://h?x", ""]
    got = judged(spark, urls)
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("net", "/", "net/", "block") and got[2] == ("net", "", None, "allow") and got[3][2:] == ("net/", "block")
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow") and got[6][2:] == ("org/fr/", "allow")
    assert got[7] == got[8] == got[12] == ("", "", None, "allow") and got[9][:2] == ("h:", "//y/z") and got[10][:2] == ("example.com:80", "/de/") and got[11][:2] == ("h", "")
    assert judged(spark, urls[:2], [("q", "/", "block")]) == {0: ("a.example.net", "/en/x", None, "allow"), 1: ("net", "/", None, "allow")}
    assert judged(spark, [None] * 3) == {i: ("", "", None, "allow") for i in range(3)}


def test_urls_with_very_many_labels(spark):
    host = "a." * 20_000 + "x.example.net"
    assert judged(spark, [f"http://{host}/en/1"])[0][2:] == ("example.net/en/", "allow")
    many = [(f"h{i}", "/", "block") for i in range(300)] + [("a.b.c", "/x", "allow"), ("b.c", "/x", "block")]
    got = judged(spark, ["http://h7/", "http://q.h299/z", "http://h300/", "http://a.b.c/x1", "http://z.b.c/x1", "http://c/x"], many)
    assert [got[i][2:] for i in range(6)] == [("h7/", "block"), ("h299/", "block"), (None, "allow"), ("a.b.c/x", "allow"), ("b.c/x", "block"), (None, "allow")]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    words = bloom.build(keys, "k")
    h = np.array([r["h"] for r in keys.select(bloom.key_hash("k").alias("h")).collect()])
    other = np.array([r["h"] for r in spark.range(20000).select(bloom.key_hash(F.concat(F.lit("z"), F.col("id").cast("string"))).alias("h")).collect()])
    assert bloom.probe(words, h).all() and bloom.probe(words, other).mean() < 0.02


# --- 2, 7


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t, public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_as_whole_texts(name):
    import pyarrow as pa

    from docloom.llm.common import utf8_column
    from docloom.llm.tokens import UnitEncoder

    t, path = tokenizer(name)
    rng = np.random.default_rng(3)
    alphabet = list("aBz09 ,.'\n\t-") + ["é", "×", "\u00a0", "中", "\u0301", "  ", "'s", "\u3000", "İ", "\x1c", "😀"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + ["", " ", "\n", "a\n\nb", "\n\nb ", "x<|endoftext|>y"]
    data, off = utf8_column(pa.array(texts))
    ids, at = UnitEncoder(path).encode(data, off)
    for text, want, a, b in zip(texts, t.encode_batch(texts, add_special_tokens=False), at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == want.ids, repr(text)


def check_pieces(rows, docs, capacity=2048):
    t, _ = tokenizer("byte_bpe_50k.json")
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"]), []).append(r)
    total = 0
    for doc_id, texts in docs.items():
        got = sorted(by.pop(doc_id), key=lambda r: (r["piece"], r["ids_crc32"]))
        for text in texts:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            total += len(ids)
            start = 0
            for piece in range(-(-len(ids) // capacity)):
                stop = len(ids) - capacity * (-(-len(ids) // capacity) - 1 - piece)
                found = next(r for r in got if (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                got.remove(found)
                start = stop
        assert not got
    assert not by
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def texts_by_id(docs):
    out = {}
    for r in docs.select("doc_id", "text").collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    return out


def test_packing(spark):
    _, path = tokenizer("byte_bpe_50k.json")
    docs = odd_documents(spark)
    used, least = check_pieces(op2_packing.pack_documents(docs, path).collect(), texts_by_id(docs))
    assert used == least
    used, least = check_pieces(op2_packing.op2_best_fit_packing(spark, SMALL).collect(), texts_by_id(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert used <= least + 1
    assert op2_packing.pack_documents(empty(docs), path).count() == 0


def test_materialized_sequences(spark):
    t, path = tokenizer("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "f")], "doc_id long, text string")
    rows = op2_packing.materialize_sequences(docs, op2_packing.pack_documents(docs, path), path).collect()
    assert sorted(x for r in rows for x in r["ids"]) == sorted(i for text in ("a b c", "d e", "f") for i in [*t.encode(text).ids, 0])


@pytest.mark.parametrize("seed", range(5))
def test_fullest_subset(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(41, np.int64)
    for x in rng.integers(3, 40, 12):
        counts[x] += rng.integers(1, 3)
    chosen = op2_packing.fullest(counts, 40)
    assert all(c <= counts[x] for x, c in chosen)
    sums = {0}
    for x in np.repeat(np.arange(41), counts):
        sums |= {s + x for s in sums if s + x <= 40}
    assert sum(x * c for x, c in chosen) == max(sums)


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32])
def test_token_blocks_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (1, 255, 256, 257, 3000):
        x = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        x[rng.integers(0, n, n // 20)] = min(top * 9, 2**32 - 1)
        content = op7_token_blocks.file_bytes(x, [None, 3], np.array([n // 2, n]))
        data, starts, names, ends = op7_token_blocks.open_file(content)
        assert (op7_token_blocks.decode_blocks(data, starts, n) == x).all() and names == [None, 3] and ends.tolist() == [n // 2, n]
        assert (op7_token_blocks.read_range(content, n // 3, n) == x[n // 3 :]).all()


def test_token_files(spark):
    t, path = tokenizer("word_bpe_49k.json")
    docs = odd_documents(spark)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in op7_token_blocks.token_blocks(docs, path, 2).collect())
    at = 0
    for (start, doc_id, n, crc), r in zip(got, docs.select("doc_id", "text").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect(), strict=True):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (start, doc_id, n, crc) == (at, r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert op7_token_blocks.token_blocks(empty(docs), path, 2).count() == 0


# --- 3


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="page"><header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies and more cookies here.</div><div class="wrap"><div class="sidebar"><p>Side text which is long enough to count as text.</p></div>
<div class="post-content post-{n}"><div class="post-header"><h2>Title &amp; more</h2><span>by me</span></div><p>First&nbsp;para <a href=x>link</a> of
 text which is quite long. {n}<p>Second <!-- no --> para &#8212; text. <script>if (a<b) {{ x("</p>") }}</script></p><ul><li>One</li><li>Two items</ul><form><p>Mail</p></form><blockquote>Quote</blockquote></div>
<div class="comments"><p>I am a comment that is long enough to count for much text.</p></div></div><footer>foot</footer></body></html>"""
TEXT = "Title & more\n\nFirst para link of text which is quite long. {n}\n\nSecond para — text.\n\nOne\n\nTwo items\n\nQuote"


def test_html(spark):
    odd = [None, "", "no markup at all, but text.", "<p>", "<div class='ad'>Buy</div>", "<p>a<b>c<p>d", "<a href='x'>l</a>" * 3, "&lt;p&gt; &am &bogus; &#0;", "<script>x", "<!-- open", "<" * 1000, "<p>" + "long " * 200_000 + "</p>"]
    rows = [(i, "http://h/1", PAGE.format(n=i)) for i in range(3)] + [(100 + i, None if i % 2 else "nourl", x) for i, x in enumerate(odd)] + [(0, "http://h/1", PAGE.format(n=0))]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = op3_html.extract_text(pages).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert all(got[i] == TEXT.format(n=i) for i in range(3))
    assert got[100] == got[101] == got[103] == got[104] == "" and got[102] == "no markup at all, but text." and got[105] == "ac\n\nd" and got[107].startswith("<p> &am &bogus;")
    assert got[111] == ("long " * 200_000).strip()
    assert op3_html.extract_text(empty(pages)).count() == 0


def test_html_of_the_given_pages(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in op3_html.op3_html_extraction(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", rows[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_hosts_vote(spark):
    main = "<div class='x'><p>A main text that is long enough to win everywhere.</p></div>"
    rows = [(i, "http://h/", f"<body>{main}<div class='y'><p>{'Some other text. ' * (1 if i else 20)}</p></div></body>") for i in range(5)]
    won = op3_html.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["host"], bytes(r["path"])) for r in won] == [("h", op3_html.path_key("body"))]


def test_all_positive_paths_vote(spark):
    deep = "<div class='a'>" * 20 + "<p>A text that is long enough to win everywhere.</p>" + "</div>" * 20
    assert len(list(op3_html.Page(deep).votes())) == 21
    # Page 0 has much text beside the deep path, the others have it there alone: the deep path's votes decide.
    rows = [(i, "http://h/", f"<body>{deep}{'<p>Beside it. ' * (i == 0)}</body>") for i in range(5)]
    won = op3_html.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert bytes(won[0]["path"]) == op3_html.path_key("body")


def test_html_loses_no_text_to_odd_markup():
    text = "<h1>T</h1><p>The running text of the page, which is long enough.</p><p>And a second paragraph of it, no shorter.</p>"
    want = "T\n\nThe running text of the page, which is long enough.\n\nAnd a second paragraph of it, no shorter."
    read = lambda s: op3_html.Page(s).text(None)
    assert read("<p class=don't>second para, it's here</p><p>b</p>") == "second para, it's here\n\nb"
    assert read(f'<article class="contact-story">{text}</article>') == want
    assert read(f'<article>{text}<section class="related-work"><p>What others did before.</p></section></article>') == want + "\n\nWhat others did before."
    assert read(f"<article>{text}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <noscript>more</noscript>.</p></article>") == want + "\n\nSo x=1 and more."
    assert read(f"<article>{text}<a href='x>y</article>") == want + "\n\ny"
    long = "<p>" + "It goes on here, as the authors say at some length. " * 10 + "</p>"
    assert read(f"<article>{text}<section class='related'>{long}</section></article>").count("goes on") == 10
    assert read(f"<article>{text}<section class='related'><p><a href=x>{long[3:-4]}</a></p></section></article>") == want
    assert read(f"<body><main>{text}</main><div class=x><p>Unmarked text beside the main element of it.</p></div></body>") == want
    assert read(f"<body><h1>Outside</h1><main><p>{text}</main></body>").startswith("Outside")


@pytest.mark.parametrize("source", ["<a href='" * 120_000, "<a href='" * 120_000 + ">", "<a b='>' c " * 90_000, "<div>" * 100_000 + "text" + "</div>" * 100_000, "<div>" * 50_000 + "</p>" * 100_000, "<ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<svg>" * 200_000, "<!" * 500_000])
def test_html_takes_linear_time_and_memory(source):
    import time
    import tracemalloc

    began = time.process_time()
    page = op3_html.Page(source)
    assert len(list(page.votes())) <= source.count("<div") + 1 and isinstance(page.text(None), str)
    assert time.process_time() - began < 8  # 0.1 to 2 s on an idle machine
    tracemalloc.start()
    op3_html.Page(source[: len(source) // 10])
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_html_wrappers_with_words_of_boilerplate(spark):
    text = "<h1>A title</h1><p>The running text of the page, which is long enough.</p><p>And a second paragraph of it, no shorter.</p>"
    around = "<nav><a href='/'>Home</a></nav>{}<div class='sidebar'><p>Side text that is long enough to count.</p></div><footer>foot</footer>"
    opened = ["div class='content-sidebar-wrap'", "div class='page has-sidebar'", "div class='menu-open'", "div class='header-fixed'", "div class='hidden-xs'", "form id='aspnetForm'", "aside", "article class='post tag-login'", "main class='contact'", "header"]
    pages = [f"<body><{o}><div class='inner'>{around.format(text)}</div></{o.split()[0]}></body>" for o in opened]
    pages += [f"<body><form id='f'><div class='header-fixed'>{around.format('<article>' + text + '</article>')}</div></form></body>"]
    pages += [f"<body>{around.format('<div class=content>' + text + '</div>')}<div class='comments'>{'<p>A long comment by somebody else.</p>' * 20}</div></body>"]
    pages += [f"<body><article>{text}</article><aside>{'<article><p>Teaser of another text, with words.</p></article>' * 20}</aside></body>"]
    pages += [f"<body><div class='ad'><p>Buy this, it is cheap and it is good and it is new.</p></div>{around.format('<div class=has-nav>' + text + '</div>')}</body>"]
    rows = [(i, f"http://h{i}/", p) for i, p in enumerate(pages)]
    want = "A title\n\nThe running text of the page, which is long enough.\n\nAnd a second paragraph of it, no shorter."
    got = {r["page_id"]: r["text"] for r in op3_html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: t for i, t in got.items() if t != want} == {}
    hidden = "<div style='display:none'>" + text + "</div>"
    assert op3_html.Page(hidden).text(None) == op3_html.Page("<div class='cookie-notice'><p>We use cookies, as all the others do.</p></div>").text(None) == ""
    deep = "<div class='sidebar'><p>Some text that goes on." * 2_000
    assert op3_html.Page(deep).blocks


# --- 4


def linked(x, label, threshold=0.93):
    n = len(x)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and y is not None for v, y in zip(x, label, strict=True)]
    out = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and label[i] == label[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                out[i, j] = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) >= threshold
    return out


def smallest(out, ids):
    comp = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in np.flatnonzero(out[i]):
                comp[i] = comp[j] = min(comp[i], comp[j], key=lambda k: ids[k])
    return [ids[c] for c in comp]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 10))
    x = [[float(c) for c in base[i % 12] + rng.normal(size=10) * 0.25 * (i % 5 > 1)] for i in range(90)]
    x += [None, [], [0.0] * 10, [1.0] * 9 + [None], [float("nan")] + [1.0] * 9, [1.0, 0.0], [2.0, 0.0], x[0], x[0], [c * 4 for c in x[0]], [float("inf")] * 10]
    label = [i % 2 for i in range(90)] + [0] * 11
    label[3] = None
    ids = list(range(1000, 1000 + len(x)))
    df = clashing(spark.createDataFrame(list(zip(ids, x, label, strict=True)), "vec_id long, embedding array<double>, label int"))
    got = {r["vec_id"]: r for r in op4_embedding_dedup.link_embeddings(df).collect()}
    want = linked(x, label)
    for i, comp, n in zip(ids, smallest(want, ids), want.sum(1), strict=True):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, comp, comp == i)
    assert want.sum() > 50
    assert op4_embedding_dedup.link_embeddings(empty(df)).count() == 0


def test_embeddings_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op4_embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(op4_embedding_dedup, "CHUNK", 5)
    test_embeddings(spark)


def test_clustered_queries_meet_few_blocks(spark, monkeypatch):
    """Of vectors in tight clusters, each is sent to the blocks of its neighbourhood, however many the label has."""
    monkeypatch.setattr(op4_embedding_dedup, "BLOCK", 128)
    sent = {}

    def watched(df, name, keep=op4_embedding_dedup.written):
        out = keep(df, name)
        if name == "op4-asked":
            sent[len(sent)] = out.count()
        return out

    monkeypatch.setattr(op4_embedding_dedup, "written", watched)
    rates = []
    for n in (1000, 4000):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 50, 32))
        x = centres[np.arange(n) % len(centres)] + rng.normal(size=(n, 32)) * 0.05
        df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got = op4_embedding_dedup.link_embeddings(df).agg(F.sum("n_links").alias("links"), F.count_distinct("component_id").alias("components")).collect()[0]
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        assert (got["links"], got["components"]) == (int((unit @ unit.T >= 0.93).sum()) - n, len(centres))
        rates.append(sent[len(sent) - 1] / n)
    assert max(rates) < 6  # blocks per vector; all are 8 and 32


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(50):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# --- 5


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of_texts(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in range(len(rows)):
        before = list(comp)
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(k)
    out = {}
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            out[k] = min(ids) if ids else None
    return [(len(s), out[k]) for k, s in enumerate(sets)]


def near_copies():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(8):
        base = list(rng.choice(words, 120))
        for copy in range(12):
            text = list(base)
            for _ in range(copy % 6):
                text[rng.integers(len(text))] = str(rng.choice(words))
            rows.append((len(rows) * 7 % 96 + 1000 * group, " ".join(text)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = near_copies() + [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in op5_minhash_dedup.near_duplicates(df, percent).collect()))
    want = sorted((d or -1, n, (c if n else d) or -1, (c if n else d) == d) for (d, _), (n, c) in zip(rows, components_of_texts(rows, percent), strict=True))
    assert got == want


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5_minhash_dedup, "BLOCK", 3)
    test_near_duplicates(spark, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_tiny_sets_differ_by_one(percent):
    rng = np.random.default_rng(percent)
    linked = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 30, rng.integers(1, 9)).astype(np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, len(a) - rng.integers(0, min(2, len(a))), replace=False), rng.integers(0, 30, rng.integers(0, 2)).astype(np.uint64))))[:8]
        if len(b) and len(a) != len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            more, less = (a, b) if len(a) > len(b) else (b, a)
            assert op5_minhash_dedup.signature(less) in op5_minhash_dedup.deletions(more, percent)
            linked += 1
        elif len(a) == len(b):
            assert (a == b).all() or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b))
    assert linked > 20


def test_near_duplicates_of_short_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]  # 5 and 4 shingles: 0.8
    got = sorted((r["doc_id"], r["component_id"]) for r in op5_minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect())
    assert got == [(d, d // 2 * 2) for d, _ in sorted(rows)]


def test_unlike_classes_of_a_bucket_ship_no_full_sets(spark):
    """10,000 classes with one band in common and nothing else: no row is left for the join with full sets."""
    rng = np.random.default_rng(9)
    regs = rng.integers(60, 120, (10_000, op5_minhash_dedup.M)).astype(np.uint8)
    regs[:, : op5_minhash_dedup.ROWS] = 7
    rows = [(1, i % 10, 0, 0, i.to_bytes(16, "big"), i.to_bytes(16, "big"), 300, r.tobytes(), i > 0) for i, r in enumerate(regs)]
    frame = spark.createDataFrame(rows, "key long, block int, slot int, band int, sig binary, comp binary, n long, regs binary, minor boolean")
    visits = frame.where("minor").withColumns({"home": F.col("block"), "block": F.explode(F.sequence(F.lit(0), F.lit(9)))}).where("block <> home").withColumn("slot", 1 + F.col("home"))
    assert op5_minhash_dedup._likely_rows(frame.unionByName(visits.drop("home")), 85).count() == 0
    same = frame.where("block = 0").limit(2).withColumn("regs", F.lit(bytes(range(256))))
    assert op5_minhash_dedup._likely_rows(same, 85).count() == 2


def test_near_duplicates_of_nothing(spark):
    assert op5_minhash_dedup.near_duplicates(empty(odd_documents(spark)), 85).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.85, 0.95):
        errors = []
        for _ in range(20):
            both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(600 * share), int(300 * (1 - share)), int(300 * (1 - share))))
            x, y = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
            r, s = op5_minhash_dedup.registers(x).astype(int), op5_minhash_dedup.registers(y).astype(int)
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(op5_minhash_dedup.estimate(np.array([(r > s).sum()]), np.array([(r < s).sum()]), np.array([float(len(x))]), np.array([float(len(y))]))[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05
    up, down, n_a, n_b = rng.integers(0, 100, 3000), rng.integers(0, 100, 3000), rng.integers(5, 900, 3000).astype(float), rng.integers(5, 900, 3000).astype(float)
    found = op5_minhash_dedup.estimate(up, down, n_a, n_b)
    sure = np.abs(found - 0.74) > 2e-3
    assert (op5_minhash_dedup.reaches(up, down, n_a, n_b, 0.74) == (found >= 0.74))[sure].all() and 100 < (found >= 0.74).sum() < 2900
    x, y = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 900))
    assert (np.maximum(op5_minhash_dedup.registers(x), op5_minhash_dedup.registers(y)) == op5_minhash_dedup.registers(np.union1d(x, y))).all()


# --- 6, 9


def planted(spark, n=400):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("n", "st", "lo") for c in ("a", "er", "is", "")]
    rows, marks = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(30, 200)))
        toxic, bad = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                text[rng.integers(len(text))] = f"grobix{rng.choice(words)}"
        rows.append((i, " ".join(w + "%%" if bad else w for w in text)))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, marks = planted(spark)
    model = op6_toxicity.train(docs, marks.where(~op6_toxicity.held_out()))
    rows = op6_toxicity.score_texts(docs, model).join(marks, "doc_id").where(op6_toxicity.held_out()).collect()
    assert len(rows) > 50 and all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)


def plain_buckets(text):
    """The n-grams' buckets in plain numbers."""
    points = [ord(c) for c in text]
    points = [p + 32 if 65 <= p <= 90 else 32 if 9 <= p <= 13 else p for p in points]
    found = set()
    for n in op6_toxicity.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + p) % 2**64
            found.add(h * 0xD1342543DE82EF95 % 2**64 >> 44)
    return found


def test_toxicity_counts_and_ratios_equal_plain_ones():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abC é\t中.")) for _ in range(rng.integers(0, 25))) for _ in range(60)]
    labels = rng.integers(0, 2, 60)
    sets = [plain_buckets(t) for t in texts]
    for text, want in zip(texts, sets, strict=True):
        assert set(op6_toxicity.features(op6_toxicity.code_points(np.frombuffer(text.encode(), np.uint8))).tolist()) == want
    counts = np.zeros((2, op6_toxicity.BUCKETS))
    for held, y in zip(sets, labels, strict=True):
        counts[y][list(held)] += 1
    n = np.bincount(labels)
    chosen, ratios = op6_toxicity.choose(counts[1], counts[0], int(n[1]), int(n[0]))
    rank = {}
    for b in set().union(*sets):
        pos, neg = (sum(b in s for s, y in zip(sets, labels, strict=True) if y == k) for k in (1, 0))
        r = np.log((pos + 1) / (n[1] + 2)) - np.log((neg + 1) / (n[0] + 2))
        if pos + neg >= op6_toxicity.MIN_DOCS and r:
            rank[b] = (abs(r) * np.sqrt(pos + neg), r)
    assert chosen.tolist() == sorted(rank) and np.allclose(ratios, [rank[b][1] for b in sorted(rank)])


def test_toxicity_fit_equals_a_dense_one():
    rng = np.random.default_rng(3)
    chosen, scale = np.arange(12), rng.normal(size=12)
    dense = rng.random((300, 12)) < 0.3
    labels = (rng.random(300) < 1 / (1 + np.exp(-(dense * scale) @ rng.normal(size=12)))).astype(int)
    got = op6_toxicity.fit([np.flatnonzero(r).astype(np.int32) for r in dense], labels, {0: 1.0, 1: 2.0}, chosen, scale)
    x, weight = np.column_stack([dense * scale, np.ones(300)]), np.where(labels, 2.0, 1.0)
    weight /= weight.sum()
    ridge = np.diag([op6_toxicity.RIDGE] * 12 + [0])

    def loss(v):
        z = x @ v
        return (weight * (np.logaddexp(0, z) - labels * z)).sum() + v @ ridge @ v / 2

    best = np.zeros(13)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-x @ best))
        best -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(13), x.T @ (weight * (p - labels)) + ridge @ best)
    mine = np.append(got.weights[:12] / scale, got.bias)
    assert loss(best) <= loss(mine) <= loss(best) + 0.01 and np.corrcoef(x @ mine, x @ best)[0, 1] > 0.98


def area(rows, column):
    """The chance that a row of class 1 scores above one of class 0."""
    one, none = (np.array([r["score"] for r in rows if r[column] == k]) for k in (1, 0))
    return ((one[:, None] > none).mean() + (one[:, None] == none).mean() / 2), len(one), len(none)


def test_classifiers_on_the_given_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for query, column, least in ((op6_toxicity.op6_toxicity, "toxic", 0.85), (op9_quality.op9_quality_classifier, "quality", 0.97)):
        rows = query(spark, sf_dir).join(marks, "doc_id").where("held_out").collect()
        auc, ones, zeros = area(rows, column)
        assert min(ones, zeros) > 3 and auc >= least, (column, auc)


def test_long_texts_are_scored_and_measured_whole(spark):
    rng = np.random.default_rng(4)
    long = " ".join(rng.choice(["one", "two", "Three,", "été", "%%"], 260_000))
    assert len(long) > 1 << 20
    points = op6_toxicity.code_points(np.frombuffer(long.encode(), np.uint8))
    parts = [op6_toxicity.features(points[i : i + 1000 + max(op6_toxicity.ORDERS) - 1]) for i in range(0, len(points), 1000)]
    assert (op6_toxicity.features(points) == np.unique(np.concatenate(parts))).all()
    got = op9_quality.document_statistics(spark.createDataFrame([(1, "a b"), (2, long)], "doc_id long, text string").coalesce(1)).collect()
    for r in got:
        assert np.allclose(np.frombuffer(r[op9_quality.STATS]), plain_statistics(r["text"]))


def plain_statistics(text):
    b = text.encode()
    words, lines = [w for w in re.split(rb"[ \t-\r]+", b) if w], [x for x in b.split(b"\n") if x]
    share = lambda kinds: sum(c in kinds for c in b) / max(len(b), 1)
    sets, odd = op9_quality._SETS, op9_quality._SETS["sign"] + op9_quality._SETS["mark"]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    sizes = [len(w) for w in words]
    counts = {w: 0 for w in words}
    for w in words:
        counts[w] += 1
    return [
        np.log1p(len(b)), np.log1p(len(words)), np.log1p(len(lines)), mean(sizes), float(np.std(sizes)) if sizes else 0.0, np.log1p(max(sizes, default=0)), np.log1p(mean([len(x) for x in lines])), share(sets["upper"]), share(sets["lower"]), share(sets["digit"]),
        share(sets["stop"]), share(sets["mark"]), share(sets["bar"]), share(sets["sign"]), share(sets["quote"]), share(sets["space"]), sum(c >= 128 for c in b) / max(len(b), 1), np.log(len(counts)) / np.log(len(words) + 1) if words else 0.0,
        len(set(lines)) / len(lines) if lines else 0.0, mean([any(c in odd for c in w) for w in words]), mean([len(w) <= 3 for w in words]), max(counts.values()) / len(words) if words else 0.0,
    ]


def test_quality_equals_a_direct_solve(spark):
    docs, marks = planted(spark, 150)
    odd = docs.unionByName(spark.createDataFrame([(1000, ""), (1001, None), (1002, "\n\n"), (1003, "Ä|b!? 12\n x x x")], "doc_id long, text string"))
    stats = op9_quality.document_statistics(odd).collect()
    for r in stats:
        assert np.allclose(np.frombuffer(r[op9_quality.STATS]), plain_statistics(r["text"] or ""))
    label = {r["doc_id"]: r["quality"] for r in marks.collect()}
    rows = [r for r in stats if r["doc_id"] in label]
    x, y = np.array([plain_statistics(r["text"]) for r in rows]), np.array([label[r["doc_id"]] for r in rows], float)
    model = op9_quality.train(op9_quality.document_statistics(docs), marks)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.sd, np.maximum(x.std(0), 1e-6), atol=1e-6)
    z = op9_quality.cosines(x, model.mean, model.sd)
    weights = np.linalg.solve(z.T @ z + op9_quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-4)


def test_isotonic_is_the_max_of_min_means():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 9, 30).astype(float)
    ones = np.array([rng.integers(0, k + 1) for k in n], float)
    at, curve = op9_quality.isotonic(np.arange(30.0), ones, n)
    want = [max(min(ones[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, 30)) for j in range(i + 1)) for i in range(30)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(curve, 9))


def test_toxicity_scores_rows_alike_one_by_one(spark):
    docs, marks = planted(spark, 100)
    model = op6_toxicity.train(docs, marks)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    many = [r["score"] for r in op6_toxicity.score_texts(docs.coalesce(1), model).orderBy("doc_id").collect()]
    alone = [model.score(op6_toxicity.features(op6_toxicity.code_points(np.frombuffer(t.encode(), np.uint8)))) for t in texts]
    assert np.allclose(many, alone, atol=1e-5)


def test_quality_held_out(spark):
    docs, marks = planted(spark)
    rows = op9_quality.quality_scores(docs, marks.where(~op6_toxicity.held_out())).join(marks, "doc_id").where(op6_toxicity.held_out()).collect()
    right = np.mean([(r["score"] >= op9_quality.THRESHOLD) == (r["quality"] == 1) for r in rows])
    assert len(rows) > 50 and right > 0.97


@pytest.mark.parametrize("reject", [op6_toxicity.reject_toxic, op9_quality.reject_low_quality])
def test_classifiers_take_odd_rows(spark, reject):
    docs = odd_documents(spark)
    kept = reject(spark, docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert reject(spark, empty(docs), labels(spark)).count() == 0
    none = reject(spark, docs, empty(labels(spark)))
    assert none.count() == docs.count()


def test_isotonic():
    at, curve = op9_quality.isotonic(np.arange(6.0), np.array([0, 3, 1, 5, 9, 10.0]), np.full(6, 10.0))
    assert (np.diff(curve) > 0).all() and np.isclose(curve, [0, 0.2, 0.5, 0.9, 1.0]).all() and np.isclose(at, [0, 1.5, 3, 4, 5]).all()


# --- 8


def test_warc(spark):
    body = "x" * 150
    rows = [(5, "http://a b/\n", body), (3, None, body), (None, "u", body), (7, "http://c", body), (8, "d", "short"), (9, "d", "short"), (10, "x", None), (11, "x", ""), (3, "x", body), (12, "y", "HTTP/1.1 é\r\n\r\n" + body), (13, "z", "1\n2 3\n" * 100_000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    from docloom.llm.common import scratch

    arcs = op8_warc.write_arcs(pages, scratch(spark, "arc"))
    folder = scratch(spark, "warc")
    op8_warc.convert_arcs(arcs, folder)
    got = op8_warc.read_warcs(spark, folder).collect()
    assert len(got) == len(rows)
    digests = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got)
    assert digests == sorted((p or -1, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows)
    same = [r for r in got if r["payload_bytes"] == 150]
    assert sum(r["record_type"] == "response" for r in same) == 1 and next(r for r in same if r["record_type"] == "response")["page_id"] == 3
    assert all(r["refers_to"] == 3 for r in same if r["record_type"] == "revisit")
    ids = {r["record_id"] for r in got}
    assert len(ids) == len(rows) and all(r["refers_to_record"] in ids for r in got if r["record_type"] == "revisit")
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100)


def test_many_empty_pages_close_archives(spark):
    import duckdb

    pages = spark.range(100_000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit(None).cast("string").alias("html")).coalesce(1)
    from docloom.llm.common import scratch

    folder = scratch(spark, "warc")
    assert op8_warc.convert_arcs(op8_warc.write_arcs(pages, scratch(spark, "arc")), folder).count() >= 5
    got = op8_warc.read_warcs(spark, folder).agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("bytes"), F.count_if(F.col("record_type") == "response").alias("responses")).collect()[0]
    assert (got["n"], got["bytes"], got["responses"]) == (100_000, 0, 100_000)
    # The SQL decides by row, as the code does.
    rows = [(3, "x" * 150), (3, "x" * 150), (None, "x" * 150), (None, "y" * 150), (None, "y" * 150), (1, "z"), (1, "z")]
    spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").createOrReplaceTempView("odd_pages")
    folder = scratch(spark, "warc")
    op8_warc.convert_arcs(op8_warc.write_arcs(spark.table("odd_pages"), scratch(spark, "arc")), folder)
    mine = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in op8_warc.read_warcs(spark, folder).collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert mine == sorted((p or 0, n, kind, to or 0) for p, n, _, kind, to in db.execute(op8_warc._SQL).fetchall())


def test_arc_versions():
    for version in (1, 2):
        data = op8_warc.arc_head(version, "n.arc") + op8_warc.arc_record(version, "dns:x y", "1.2.3.4", "20200102030405", "text/dns", b"a\nb") + op8_warc.arc_record(version, "http://z", "1.2.3.4", "202001020304", "text/html", b"HTTP/1.1 200 OK\r\n\r\nq")
        got = list(op8_warc.read_arc(op8_warc.gunzip(op8_warc.gzip_member(data[:50]) + op8_warc.gzip_member(data[50:]))))
        assert [(r.url, r.date, r.mime, r.content) for r in got] == [("dns:x y", "20200102030405", "text/dns", b"a\nb"), ("http://z", "202001020304", "text/html", b"HTTP/1.1 200 OK\r\n\r\nq")]
        with pytest.raises(ValueError, match="ends within"):
            list(op8_warc.read_arc(data[:-3]))
    assert op8_warc.iso_time("202001020304") == "2020-01-02T03:04:00Z"
    fields, block = next(op8_warc.read_warc(op8_warc._converted("a.arc", 1, got[0], None)))
    assert fields["warc-type"] == "resource" and block == b"a\nb" and fields["content-type"] == "text/dns"


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op8_warc.op8_warc_conversion(spark, str(tmp_path)).count() == 0


# --- 10


def brute_contamination(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, held = words(text), set(), set()
    for name, item in items:
        v = words(item)
        for s in range(max(1, len(v) - size + 1)) if v and name is not None else ():
            window = v[s : s + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    held.add(str(name))
    return len(w), len(hit), ",".join(sorted(held))


def test_contamination(spark, monkeypatch):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, phrase), (2, "Two words"), (2, "other words"), (3, None), (4, "!!!"), (10, "Été 中文"), (None, phrase), (5, "a a a a a a a a a a a")]
    texts = [(1, f"x {phrase.upper()}. y"), (2, "two-words"), (3, None), (4, ""), (5, "a " * 30), (5, phrase), (6, "kappa lambda mu " + phrase), (None, "été, 中文"), (7, ("filler " * 50_000) + phrase)]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    tests = clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((d or -1, *brute_contamination(t, items)) for d, t in texts)
    for words, group, step in ((500_000, 16 << 20, 100_000), (4, 1, 7)):  # one block of items, several; all segments together, each alone
        monkeypatch.setattr(op10_decontamination, "BLOCK_WORDS", words)
        monkeypatch.setattr(op10_decontamination, "GROUP_BYTES", group)
        monkeypatch.setattr(op10_decontamination, "_STEP", step)
        assert len(op10_decontamination.write_blocks(tests)) == 1 or words == 4
        rows = op10_decontamination.contamination(docs, tests).collect()
        assert sorted((r["doc_id"] or -1, r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), ",".join(r["items"])) for r in rows) == want
    assert op10_decontamination.contamination(empty(docs), tests).count() == 0
    assert not any(r["items"] for r in op10_decontamination.contamination(docs, empty(tests)).collect())


def segments_of(texts, limit):
    """Segments as build_index stores them, without Spark."""
    import pyarrow as pa

    from docloom.llm.common import row_chunks, utf8_column

    data, off = utf8_column(pa.array(texts))
    for i, j in row_chunks(off, limit):
        h, first = op10_decontamination.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        order = np.argsort(h, kind="stable")
        terms, counts = np.unique(h, return_counts=True)
        steps = np.diff(order.astype("<u4"), prepend=np.uint32(0))
        yield op10_decontamination.Segment({"doc_ids": list(range(i, j)), "n_words": np.diff(first), "terms": terms.tobytes(), "counts": counts.astype("<u4").tobytes(), "postings": np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()})


@pytest.mark.parametrize(("seed", "slop"), [(s, k) for s in range(4) for k in (0, 1, 2)])
def test_windows_equal_brute_force(seed, slop, monkeypatch):
    monkeypatch.setattr(op10_decontamination, "_STEP", 7)
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(20)]
    items = [(str(i), " ".join(rng.choice(vocabulary, rng.integers(1, 6)))) for i in range(12)]
    hashes = lambda t: op10_decontamination.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
    block = op10_decontamination.Block.read(op10_decontamination.Block.of([(n, hashes(t)) for n, t in items], 4).content())
    got = set()
    for segment in segments_of(texts, 100):
        for doc, start, stop, item in segment.occurrences(block, 4, slop):
            got.update((segment.doc_ids[d], a, b, block.names[i]) for d, a, b, i in zip(doc.tolist(), start.tolist(), stop.tolist(), item.tolist(), strict=True))
    want = set()
    for d, text in enumerate(texts):
        w = text.split()
        for name, item in items:
            v = item.split()
            for k in range(max(1, len(v) - 3)):
                window = v[k : k + 4]
                for s in range(-slop - 4, len(w) + slop):
                    if all(t in w[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, t in enumerate(window)):
                        want.add((d, max(s, 0), min(s + len(window), len(w)), name))
    assert got == want and want


def test_a_large_benchmark_takes_bounded_memory():
    """Two million words of test items in blocks: 500 MB is the limit, about 100 are used."""
    import tracemalloc

    rng = np.random.default_rng(1)
    vocabulary = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    tracemalloc.start()
    for _ in range(4):
        block = op10_decontamination.Block.read(op10_decontamination.Block.of([(str(i), rng.choice(vocabulary, 50)) for i in range(10_000)], 10).content())
    text = rng.choice(vocabulary[:25_000], 700_000)
    order = np.argsort(text, kind="stable")
    terms, counts = np.unique(text, return_counts=True)
    steps = np.diff(order.astype("<u4"), prepend=np.uint32(0))
    segment = op10_decontamination.Segment({"doc_ids": [1], "n_words": [len(text)], "terms": terms.tobytes(), "counts": counts.astype("<u4").tobytes(), "postings": np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()})
    assert sum(len(doc) for doc, *_ in segment.occurrences(block, 10, 0)) == 0
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_texts_longer_than_a_segment(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(f"w{i}" for i in range(900_000))
    docs = spark.createDataFrame([(1, "x"), (2, f"{long} {phrase}"), (3, phrase), (4, f"{phrase[:20]} {long}")], "doc_id long, text string").coalesce(1)
    assert len(long) > op10_decontamination.SEGMENT_BYTES
    got = {r["doc_id"]: (r["n_words"], r["items"], [tuple(s) for s in r["spans"]]) for r in op10_decontamination.contamination(docs, spark.createDataFrame([(9, phrase)], "item_id long, text string")).collect()}
    assert got[2] == (900_010, ["9"], [(900_000, 900_010)]) and got[3] == (10, ["9"], [(0, 10)]) and not got[1][1] and not got[4][1]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one very two three"), (2, "one far far far two three")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r["doc_id"]: bool(r["items"]) for r in op10_decontamination.contamination(docs, item, 3, 1).collect()} == {1: True, 2: False}
    assert not any(r["items"] for r in op10_decontamination.contamination(docs, item, 3, 0).collect())




def test_html_words_leave_nothing_out_of_articles():
    """Inside an article only parts of a page, lists of links and structures of comments go by their names."""
    prose = "<p>" + "Some running prose that is long enough to count as text here. " * 2 + "</p>"
    text = " ".join(["Some running prose that is long enough to count as text here."] * 2)
    read = lambda s: op3_html.Page(f"<body><nav><a href=x>Menu</a></nav>{s}<footer>foot</footer></body>").text(None)
    for tag in ("article", "main"):
        page = lambda s, tag=tag: read(f"<{tag}><h1>T</h1>{s}</{tag}>")
        assert page("<div class='social'><p>First of it.</p><p>Second.</p></div>") == "T\n\nFirst of it.\n\nSecond."
        assert page(f"{prose}<section id='discussion'><h2>Discussion</h2>{prose}</section>") == f"T\n\n{text}\n\nDiscussion\n\n{text}"
        assert page(f"{prose}<div class='menu-list'><p>Two eggs.</p></div>") == f"T\n\n{text}\n\nTwo eggs."
        assert page(f"{prose}<div class='comment'><p>One remark of the author.</p></div>") == f"T\n\n{text}\n\nOne remark of the author."
        for gone in ("<section class='comments'><h2>Comments</h2><div class='comment'><p>I like it.</p></div></section>", "<div class='comment'><p>I like it.</p></div>" * 2, "<div class='ad'><p>Buy it.</p></div>", "<div class='sidebar'><p>About us.</p></div>", "<div class='share'><a href=a>Share</a> <a href=b>Mail</a></div>", "<aside><p>An aside.</p></aside>", "<div role='search'><p>Find.</p></div>"):
            assert page(prose * 2 + gone) == f"T\n\n{text}\n\n{text}", gone


def plain_winners(rows):
    """Every host's winning path by plain sums over the pages' own scores."""
    sums = {}
    for _, url, source in rows:
        host = url.split("://")[1].split("/")[0]
        page = op3_html.Page(source)
        scores = page.scores()
        top = max(s for s in scores if s is not None)
        for key, depth, score in zip(page.keys, page.depths, scores, strict=True):
            if score is not None and score > 0:
                votes, _ = sums.setdefault(host, {}).get(key, (0, depth))
                sums[host][key] = (votes + score * op3_html.UNIT // top, depth)
    return {h: min(found, key=lambda k: (-found[k][0], -found[k][1], k)) for h, found in sums.items()}


def test_html_votes_over_random_trees(spark):
    """Scores against a walk over the tree that made each page; winners against plain sums of the votes."""
    rng = np.random.default_rng(8)
    names = ["div class='a'", "div class='b7'", "section", "div id='c'", "div"]

    def tree(depth):
        kids = [tree(depth - 1) if depth and rng.random() < 0.6 else "w" * int(rng.integers(25, 90)) for _ in range(rng.integers(1, 4))]
        return (names[rng.integers(len(names))], kids)

    def html(node):
        return f"<p>{node}</p>" if isinstance(node, str) else f"<{node[0]}>{''.join(map(html, node[1]))}</{node[0].split()[0]}>"

    def size(node):
        return len(node) if isinstance(node, str) else sum(map(size, node[1]))

    def walk(node, above, found):
        if not isinstance(node, str):
            suffix = {"a": ".a", "b7": ".bN", "c": "#c"}.get((node[0].split("'") + [""])[1], "")
            key = op3_html.path_key([node[0].split()[0] + suffix], above)
            found[key] = found.get(key, 0) + size(node)
            for kid in node[1]:
                walk(kid, key, found)

    rows = []
    for k in range(60):
        root = tree(3)
        rows.append((k, f"http://h{k % 4}/x", f"<body>{html(root)}</body>"))
        page, want = op3_html.Page(rows[-1][2]), {op3_html.path_key("body"): size(root)}
        walk(root, op3_html.path_key("body"), want)
        assert dict(zip(page.keys, page.scores(), strict=True)) == want
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_winners(rows)
    assert {r["host"]: bytes(r["path"]) for r in op3_html.host_paths(frame.repartition(3)).collect()} == want
    for r in op3_html.extract_text(frame).collect():
        assert r["text"] == op3_html.Page(rows[r["page_id"]][2]).text(want[f"h{r['page_id'] % 4}"])


def test_toxicity_trains_on_one_text_of_each_sampled_id(spark, monkeypatch):
    seen = []
    fit = op6_toxicity.fit
    monkeypatch.setattr(op6_toxicity, "fit", lambda rows, *rest: seen.append(len(rows)) or fit(rows, *rest))
    docs = spark.range(8000).select((F.col("id") % 2).alias("doc_id"), F.concat_ws(" ", F.lit("some text with words"), F.when(F.col("id") % 2 == 1, "grobix grobix").otherwise("nothing"), "id").alias("text"))
    marks = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    op6_toxicity.train(docs, marks)
    assert all(n <= 2 * op6_toxicity.SAMPLE for n in seen) and not any(n > 2 for n in seen)


def test_near_duplicates_and_leaks_carry_ids_of_strings_and_binaries(spark):
    rows = [(b"\x00\x01", "one two three four five six"), (b"\xff", "one two three four five six"), (b"z", "nothing else is like this one at all"), (None, "")]
    for kind, show in (("binary", lambda x: x), ("string", lambda x: None if x is None else x.hex())):
        docs = spark.createDataFrame([(show(i), t) for i, t in rows], f"doc_id {kind}, text string")
        found = {(None if r["doc_id"] is None else r["doc_id"]): (r["component_id"], r["kept"]) for r in op5_minhash_dedup.near_duplicates(docs).collect()}
        found = {None if k is None else k if kind == "string" else bytes(k): v for k, v in found.items()}
        low = show(b"\x00\x01")
        assert [v[1] for k, v in sorted(found.items(), key=lambda x: str(x[0])) if k is not None].count(True) == 2 and found[low][1] and found[None] == (None, True)
        hits = op10_decontamination.contamination(docs, spark.createDataFrame([(1, "like this one")], "item_id long, text string")).where("size(items) > 0").collect()
        assert [r["doc_id"] if kind == "string" else bytes(r["doc_id"]) for r in hits] == [show(b"z")]


def test_embeddings_with_labels_of_any_type(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (2, v, "a"), (3, v, "a|"), (4, v, "7"), (5, v, None), (6, [x * 2 for x in v], "7")]
    for kind in ("string", "binary"):
        frame = spark.createDataFrame([(i, x, s if kind == "string" or s is None else s.encode()) for i, x, s in rows], f"vec_id long, embedding array<float>, label {kind}")
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op4_embedding_dedup.link_embeddings(frame).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (0, 5), 6: (1, 4)}


def test_many_archives_in_few_tasks(spark, monkeypatch):
    from docloom.llm.common import scratch

    monkeypatch.setattr(op8_warc, "ARCHIVE_RECORDS", 2)
    monkeypatch.setattr(op8_warc, "TASK_ARCHIVES", 16)
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.concat(F.lit("page " * 30), (F.col("id") % 7).cast("string")).alias("html"))
    arcs = op8_warc.write_arcs(pages.repartition(3), scratch(spark, "arc"))
    assert arcs.count() >= 300
    folder = scratch(spark, "warc")
    assert op8_warc.convert_arcs(arcs, folder).rdd.getNumPartitions() <= 32
    kinds = {r["record_type"]: r["count"] for r in op8_warc.read_warcs(spark, folder).groupBy("record_type").count().collect()}
    assert kinds == {"response": 7, "revisit": 593}
