import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from leadloom.llm import html, packing, rules, tokens
from leadloom.llm.bpe import PairTable, merge_all
from leadloom.llm.common import table
from leadloom.llm.hashing import Batch, ranges_hash

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "  \n\n x", "a\t\tb  \n", "▁▁ a▁b", "🙂🙂x́é", "<s>hi</s><unk>\x00\x01", "x" * 1000, "ab " * 500, " " * 300, "中文字符测试" * 50, "don't I'll 12345 67", "a\xa0b　 c", "\r\n\r\n a", "<|endoftext|> a<|startoftext|>b", "\x1c a\x1d\x1e \n b", "İSTANBUL ΣΑΣ"]


def thue_morse(n):
    """A word over a and b and its complement: any polynomial hash modulo a power of two gives them one value."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return [s, s.translate(str.maketrans("ab", "ba"))]


TWINS = thue_morse(200) + thue_morse(1024) + thue_morse(8192) + [f"{w} and {w} " * 3 for w in thue_morse(1024)]


def random_texts(seed, n=20):
    r = random.Random(seed)
    return ["".join(r.choice("ab \n'.!é▁\t0Z") for _ in range(r.randrange(200))) for _ in range(n)] + ["".join(chr(r.randrange(1, 0x3FFF)) for _ in range(400))]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in table(spark, SF, "documents").limit(120).collect()] + ODD + TWINS + random_texts(3)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)


def test_words_of_a_batch():
    b = Batch.of(["a  bb\n", None, "", "bb a"])
    w = b.words()
    assert w.counts.tolist() == [2, 0, 0, 2] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] and w.hash[0] != w.hash[1]
    assert len(w.windows(2)[0]) == 2


def test_twin_ranges_are_told_apart():
    for n in (8, 64, 200, 1024, 8192):
        one, two = ranges_hash(*whole(thue_morse(n)), both=True)
        assert one[0] != one[1] and two[0] != two[1]
    lines = ["\n".join(thue_morse(n)) for n in (200, 1024)]
    assert rules.base_counts(lines)["n_dup_lines"].tolist() == [0, 0]
    windows = [" ".join(w[k : k + 256] for w in thue_morse(2048) for k in range(0, 2048, 256)) for _ in range(1)]
    words = windows[0].split()
    assert len(set(words)) == len(np.unique(Batch.of(windows).words().hash))


def whole(texts):
    batch = Batch.of(texts)
    return batch.buffer, batch.offset[:-1], batch.offset[1:] - 1


@pytest.mark.parametrize("bits", [0, 3])
def test_the_store_is_exact_when_first_hashes_collide(monkeypatch, bits):
    real = tokens.ranges_hash

    def weak(*args, **kwargs):
        one, two = real(*args, **kwargs)
        return one & np.uint64((1 << bits) - 1), two

    monkeypatch.setattr(tokens, "ranges_hash", weak)
    segments, r = tokens.SegmentStore(most=40, most_ids=300), random.Random(bits)
    for _ in range(30):
        batch = Batch.of([" ".join(f"w{r.randrange(60)}" for _ in range(25)) for _ in range(3)])
        words = batch.words()
        ids, offset = segments.encode(batch, words.start, words.end, lambda some: [np.array(list(x), np.int32) for x in some])
        raw = batch.buffer.tobytes()
        assert [bytes(ids[a:b].tolist()) for a, b in zip(offset[:-1], offset[1:])] == [raw[a:b] for a, b in zip(words.start, words.end)]


def test_merges_take_the_leftmost_least_pair():
    t = PairTable(*map(np.array, ([0, 2, 0], [1, 0, 0], [1, 0, 2], [2, 3, 4])))
    seqs = [[0, 1, 0, 1], [0, 0, 0], [1], [], [0] * 300, [0, 1] * 200, [-1, 0, 1, -1]]
    out = merge_all(np.array(sum(seqs, []), np.int32), [len(s) for s in seqs], t)
    assert [o.tolist() for o in out[:4]] == [[3, 1], [4, 0], [1], []] and len(out[4]) == 150 and out[6].tolist() == [-1, 2, -1]


def test_round_trip_equals_the_library(spark, texts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ByteBpe.load(path).ranks, special_tokens={})
    out = {r.doc_id: r for r in tokens.bpe_round_trip(frame(spark, texts), path, P.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = np.array(lib.encode_ordinary(t or ""), "<u4").tobytes()
        assert out[i].ids == ids and out[i].n_tokens == len(ids) // 4 and out[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert out[i].decoded == (t or "").encode() and out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert tokens.bpe_round_trip(frame(spark, texts).limit(0), path, P.PATTERN).count() == 0


def test_counts_equal_the_library(spark, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {r.doc_id: r for r in tokens.token_counts(frame(spark, texts), path, limit=500).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or ""))
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 500)
    assert len(tokens.PieceBpe.load(path).whole_tokens) > 30_000


def padding(frame, length):
    used = frame.groupby("sequence_id").length.sum()
    return sum(0 if n & (n - 1) == 0 else length - n for n in used) / used.sum()


def test_packing_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    out = packing.pack(frame(spark, texts), path).toPandas().sort_values(["doc_id", "start"])
    for i, own in out.groupby("doc_id"):
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    assert out.doc_id.nunique() == len(texts)
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 2048).all() and all(o.tolist() == [0, *n.cumsum()[:-1]] for (_, o), (_, n) in zip(by.offset, by.length))
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


def test_packing_of_many_documents_has_little_padding(spark):
    out = packing.pack(table(spark, "/root/testdata/sf0.01", "documents"), P.path("word_bpe_49k.json")).toPandas()
    assert padding(out, 2048) < 0.02


@pytest.mark.parametrize("n", [1, 30, 5000])
def test_patterns_hold_the_demand(n):
    r = np.random.default_rng(n)
    size, demand = np.unique(np.minimum(np.exp(r.normal(4, 1, n)).astype(int) + 1, 512), return_counts=True)
    found = packing.solve_patterns(size, demand, 512)
    assert sum(t * c for t, c in found).tolist() == demand.tolist() and all((c * size).sum() <= 512 for _, c in found)
    assert sum(t for t, _ in found) <= -(-(size * demand).sum() // 512) * 1.02 + 1


def test_knapsack_is_best():
    value, counts = packing.best_pattern(np.array([1.0, 2.1, 3.0]), np.array([2, 4, 6]), 11)
    assert counts.tolist() == [1, 2, 0] and abs(value - 5.2) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy this and that for the best of the prices in town</div>
<article><h1>Big &amp; bold</h1><p><b>The first paragraph of the text,<br>with a break &#233;<p>Second   one</p>
<script>var x = "<p>no</p>";</script><div id="comments"><p>I like the page and all of the words in it</p></div></article>
<aside>More of the same for you to read</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Big & bold\n\nThe first paragraph of the text, with a break é\n\nSecond one"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("plain words only") == "plain words only"
    assert html.main_text("<p title='a>b'>x</p><!-- c") == "x"
    plain = "<body><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><h2>Title</h2><p>This is the text of a page, and it has many of the words that are in all texts of the kind.</p><p>Short.</p></body>"
    assert html.main_text(plain).split("\n\n")[0] == "Title" and html.main_text(plain).endswith("Short.") and "One" not in html.main_text(plain)
    assert len(html.main_text("<p>" + "word " * 200_000)) == 999_999 and html.main_text("<a " + "b" * 50_000) is not None


PROSE = "This is the text of a page, and it has many of the words that are in all texts of the kind."


def test_class_names_do_not_empty_a_page():
    for wrapper in ("class='layout has-sidebar'", "class=no-sidebar", "class='with-nav'", "class='legal-article'", "class=search-result", "class=widget", "id=search", "class='notice wrap'"):
        assert html.main_text(f"<body><div {wrapper}><article><h1>Title</h1><p>{PROSE}</p></article></div></body>") == f"Title\n\n{PROSE}"
        assert html.main_text(f"<body><div {wrapper}><div class=ad><p>Buy it</p></div><h1>Title</h1><p>{PROSE}</p></div></body>") == f"Title\n\n{PROSE}"
    assert html.main_text(f"<form id=aspnet><main><p>{PROSE}</p></main></form>") == PROSE
    assert html.main_text("<div class=widget><article><p>Short.</p></article></div>") == "Short."
    related = f"<div class=related><article><p>{PROSE} {PROSE}</p></article></div>"
    assert html.main_text(f"<article><p>{PROSE}</p><div class=comments><p>{PROSE} {PROSE}</p></div></article>{related}") == PROSE
    assert html.main_text(f"<div><p>{PROSE}</p></div><div class=ad><p>Buy this and that for the best of the prices in town</p></div>") == PROSE


def test_extraction_equals_the_articles(spark):
    import re

    rows = table(spark, SF, "pages")
    out = {r.page_id: r for r in html.extract_main_text(rows.withColumn("text", F.lit(1))).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x)))).strip() for x in re.split("</?(?:p|h1)>", inner)]
        assert out[r.page_id].text == "\n\n".join(x for x in blocks if x) and out[r.page_id].n_chars == len(out[r.page_id].text)
    assert html.extract_main_text(rows.limit(0)).count() == 0


def test_text_rules_decide_without_names(spark):
    """With all names of articles, menus, footers and classes taken away the rules on text find the same blocks."""
    import re

    wrong = total = 0
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        bare = re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", r.html))
        want, got = html.main_text(r.html).split("\n\n"), html.main_text(bare).split("\n\n")
        total += len(html.blocks_of(bare))
        wrong += sum(((Counter(want) - Counter(got)) + (Counter(got) - Counter(want))).values())
    assert wrong <= 0.01 * total


def test_prose_beside_an_article_and_lone_notices():
    assert html.main_text(f"<article><p>{PROSE}</p></article><p>{PROSE} {PROSE}</p><p>Short.</p>") == f"{PROSE}\n\n{PROSE} {PROSE}"
    notice = "<div>We use cookies on this site and by the use of it you agree to that</div>"
    assert html.main_text(f"{notice}<div><h1>Title</h1><p>{PROSE}</p><p>Short.</p></div>{notice}") == f"Title\n\n{PROSE}\n\nShort."
    assert html.main_text("<ul><li><a href=a>Home</a></li></ul><div><p>One.</p><p>Two.</p></div><div>Three</div>") == "One.\n\nTwo."


def test_articles_keep_links_tables_and_names_with_a_hint_in_them():
    def kept(inner: str, want: str) -> None:
        page = f"<nav><a href=/>Home</a></nav><article><p>{PROSE}</p>{inner}<p>{PROSE}</p><div class='comments thread-3'><p>{PROSE}</p></div></article><footer>me</footer>"
        assert html.main_text(page) == "\n\n".join(x for x in (PROSE, want, PROSE) if x), inner

    assert html.main_text(f"<article><h1><a href=/t>A title</a></h1><p>{PROSE}</p></article>") == f"A title\n\n{PROSE}"
    assert html.main_text(f"<article><p>{PROSE}</p><ul><li><a href=/s>One source</a></li><li><a href=/t>Two</a></li></ul><div class=comments><p>{PROSE}</p></div></article>") == f"{PROSE}\n\nOne source\n\nTwo"
    kept("<ul><li><a href=/s>One source</a></li><li><a href=/t>Another</a></li></ul>", "One source\n\nAnother")
    kept("<p><a href=/all>All of it is one link</a></p>", "All of it is one link")
    kept("<table class='share prices'><tr><td>ACME</td><td>12.5</td></tr></table>", "ACME\n\n12.5")
    kept("<div id='social-history'><p>None.</p></div>", "None.")
    kept("<p class='legal-history'>Short.</p>", "Short.")
    kept("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>", "x=1")
    kept("<object data=a><p>In place of it.</p></object>", "In place of it.")
    for name in ("ad", "ad-box", "ad-300x250", "share-buttons", "related posts-3", "reader-comments", "cookie-notice"):
        kept(f"<div class='{name}'><p>Short.</p><p>{PROSE}</p></div>", "")
    kept("<p class=ad>Buy it now</p>", "")
    kept("<button>Send</button>", "")


def test_comments_beside_an_article_go_and_stories_beside_teasers_stay():
    comment = f"<section class=talkback><p>{PROSE} I do not think so and so it is.</p></section>"
    assert html.main_text(f"<article><p>{PROSE}</p><p>{PROSE}</p></article>{comment}") == f"{PROSE}\n\n{PROSE}"
    assert html.main_text(f"<main><h1>Title</h1><article><p>{PROSE}</p><p>{PROSE}</p></article>{comment}</main>") == f"Title\n\n{PROSE}\n\n{PROSE}"
    story = f"{PROSE} {PROSE} {PROSE}"
    assert story in html.main_text(f"<main><div><p>{story}</p></div><article><p>{PROSE}</p></article></main>")
    assert html.main_text(f"<main><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><h1><a href=c>Title</a></h1><p>{PROSE}</p></main>") == f"Title\n\n{PROSE}"
    assert html.main_text(f"<div><h2><a href=c>Title</a></h2><p>{PROSE}</p><p>Short.</p></div>") == f"Title\n\n{PROSE}\n\nShort."


@pytest.mark.parametrize("page", ["<a ", "<div></b>", "<div><article>", "<div><article></article>", '<p a="', "<!", "<script></script ", "<p>x ", "<b><p>", "<div class=ad>", "&", "<ul><li>a", "<![CDATA[", "<!--"])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.time()
    html.main_text(page * (500_000 // len(page)))
    assert time.time() - began < 10


def test_token_operators_on_repeated_null_and_empty_rows(spark):
    piece, byte, word = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
    long = "the quick brown fox " * 60_000
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x y"), (4, long)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_bytes int, kind int")
    counts = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, piece).collect()), key=str)
    assert len(counts) == 6 and counts[0] == counts[1] and {(2, 0, 0), (3, 0, 0)} <= set(counts) and any(i == 4 and n == len(long) for i, n, _ in counts)
    trips = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in tokens.bpe_round_trip(df, byte, P.PATTERN).collect()), key=str)
    assert len(trips) == 6 and trips[0] == trips[1] and (4, trips[4][1], hashlib.sha256(long.encode()).hexdigest()) in trips
    packed = packing.pack(df, word).toPandas()
    assert (packed[packed.start == 0].groupby("doc_id", dropna=False).size().sort_index().tolist()) == [2, 1, 1, 1, 1]
    assert packed[packed.doc_id == 4].length.sum() == packed[packed.doc_id == 4].doc_tokens.iloc[0]
    for out in (tokens.token_counts(df.limit(0), piece), tokens.bpe_round_trip(df.limit(0), byte, P.PATTERN), packing.pack(df.limit(0), word)):
        assert out.count() == 0


def test_extraction_of_repeated_null_and_empty_pages(spark):
    page = f"<article><p>{PROSE}</p></article>"
    df = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (None, "v", "", 1), (3, "w", "<p>a" * 100_000, 1)], "page_id long, url string, html string, n_chars int")
    out = sorted(((r.page_id, r.url, r.text[:20], r.n_chars) for r in html.extract_main_text(df).collect()), key=str)
    assert out[0] == out[1] == (1, "u", PROSE[:20], len(PROSE)) and (2, None, "", 0) in out and (None, "v", "", 0) in out and len(out) == 5
