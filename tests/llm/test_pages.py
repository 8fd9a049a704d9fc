import hashlib

from rainloom.llm import htmltext, warc
from rainloom.llm.common import Scratch
from rainloom.llm.html_blocks import leaf_blocks


def pages_of(spark):
    big = "z" * 1_500
    rows = [(1, "http://www.Example.com/a?b=c d", big), (2, "https://example.com:443/x", big), (3, "http://example.com/x", big), (4, "http://example.com/x", "small"), (5, "http://example.com/x", "small")]
    rows += [(6, None, None), (7, "", "é" * 999), (None, "http://n/", big), (9, "not a url [", "<p>"), (9, "not a url [", "<p>")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")


def test_warc_round_trip(spark):
    df = pages_of(spark)
    got = {}
    for r in warc.archived(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == df.count()
    for r in df.collect():
        body = (r.html or "").encode()
        one = got[r.page_id][0]
        assert (one.payload_bytes, one.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert [got[i][0].record_type for i in (1, 2, 3, 4, 5, None)] == ["revisit", "revisit", "response", "response", "response", "revisit"]
    assert got[1][0].refers_to == 3 and got[3][0].refers_to is None
    assert warc.archived(df.filter("false")).collect() == []


def test_warc_lookup_by_slices(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 5}.example.org/p{i % 40}", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    with Scratch(spark) as scratch:
        captures = scratch.table("c", warc.write_archive(df, scratch.path("w")))
        directory = scratch.table("d", warc.write_index(captures, scratch.path("i"), 8))
        wanted = warc.keys_of(df.filter("page_id % 7 = 0"))
        for rows in (3, 1_000):
            found = warc.lookup(wanted, directory, scratch.path("i"), scratch.path("w"), rows).collect()
            assert sorted((r.page_id, bytes(r.payload)) for r in found) == [(i, f"<p>{i}</p>".encode()) for i in range(0, 300, 7)]


def test_url_keys_sort_by_reversed_host():
    assert warc.url_key("http://www.Example.com:8080/a b?q=1") == "com,example,www)/a%20b?q=1"
    assert " " not in warc.capture_key("x y", 3).rsplit(" ", 1)[0]
    assert warc.capture_key("http://a/", -5) < warc.capture_key("http://a/", 7)


def test_blocks_of_broken_html():
    texts = [b.text for b in leaf_blocks('<p>a &amp b<br>c<p>d<script>if (a<b) "</p>"</script> e<ul><li>f<li>g</ul><!-- x --><div title=">">h</div><p>i <b')]
    assert texts == ["a & b c", "d e", "f", "g", "h", "i"]
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<script>x") == []
    assert len(leaf_blocks("<" * 50_000 + "x")) <= 1


def test_extraction_of_held_out_layouts(spark):
    chain = htmltext.trained()
    wrong = total = 0
    for page, labels in htmltext.labelled_pages(120, seed=5):
        found = chain.decode(htmltext.block_features(leaf_blocks(page)))
        wrong += int((found != labels).sum())
        total += len(labels)
    assert wrong / total < 0.02


def test_extraction_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = htmltext.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert not any("track(" in r.text or "©" in r.text or "margin:0" in r.text for r in rows)
    odd = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>It is a sentence.</p>", 1), (4, "u", "<nav><a href=x>Home</a></nav>", 1)], "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in htmltext.extract(odd).collect()} == {1: "", 2: "", None: "It is a sentence.", 4: ""}
    assert htmltext.extract(pages.filter("false")).collect() == []


BODY = "<h1>Title of it</h1><p>Some text of the article is here. It goes on.</p><p>And on it goes, again.</p>"
MAIN = "Title of it\nSome text of the article is here. It goes on.\nAnd on it goes, again."
CASES = [
    ("<article><p>One sentence only here.</p></article>", "One sentence only here."),
    ("<article><pre>x = 1\ny = 2</pre></article>", "x = 1 y = 2"),
    (f'<body><div class="popular-science-article">{BODY}</div></body>', MAIN),
    (f'<div class="mw-search-results body">{BODY}</div>', MAIN),
    (f'<article>{BODY}<div class="reviews"><p>Nice phone, I like it a lot.</p></div></article>', MAIN),
    (f'<article>{BODY}<div class="kommentare"><p>Nice phone, I like it a lot.</p></div></article>', MAIN),
    (f'<article>{BODY}</article><div class="comentarios"><p>Nice phone, I like it a lot.</p></div>', MAIN),
    # Names that say nothing: comments of one shape, a menu, a footer of links.
    (f'<article>{BODY}<div class="xyz"><div class="q"><b>Bob</b><p>Nice phone, I like it.</p></div><div class="q"><b>Al</b><p>No, bad phone.</p></div><div class="q"><b>Jo</b><p>It is.</p></div></div></article>', MAIN),
    (f'<div class="zork"><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div class="blarg">{BODY}</div><footer>&copy; 2020 X</footer>', MAIN),
    ("<article><h1>A</h1><p>Press <button>OK</button> to go on with it.</p></article>", "A\nPress to go on with it."),
    ("<nav><a href=x>Home</a></nav>", ""),
]


def test_extraction_cases():
    chain = htmltext.trained()
    assert [htmltext.main_text(page, chain) for page, _ in CASES] == [text for _, text in CASES]


def test_extraction_of_deep_and_long_pages():
    """Linear in the page: ancestors are shared, however deep."""
    import time

    chain = htmltext.trained()
    assert len(leaf_blocks("<div>x" * 10_000)) == 10_000
    took = []
    for n in (5_000, 40_000):
        begun = time.process_time()
        htmltext.main_text("<div>x" * n, chain)
        text = htmltext.main_text(f"<article>{'<p>It is a sentence of some words.' * n}</article>", chain)
        took.append(time.process_time() - begun)
        assert text.count("\n") == n - 1
    assert took[1] < 8 * 4 * took[0]


def test_viterbi_against_all_labellings():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        n, width = int(rng.integers(1, 9)), 6
        chain = htmltext.Chain(rng.normal(size=(width, 2)), rng.normal(size=(2, 2)))
        x = [tuple(rng.choice(width, rng.integers(1, width), replace=False).tolist()) for _ in range(n)]

        def score(y, x=x, chain=chain):
            return sum(chain.emission[list(f), k].sum() for f, k in zip(x, y, strict=True)) + sum(chain.transition[a, b] for a, b in zip(y, y[1:], strict=False))

        assert tuple(chain.decode(x)) == max(product((0, 1), repeat=n), key=score)


def test_extraction_of_repeated_rows(spark):
    rows = [(1, "u", CASES[0][0]), (1, "u", CASES[0][0]), (2, None, f"<article><p>{'word ' * 200_000}</p></article>")]
    got = sorted((r.page_id, r.n_chars) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, 23), (1, 23), (2, 999_999)]


def test_warc_records_resolve(spark):
    """Every revisit names the record id of a response with its digest; every file begins with a warcinfo record."""
    import gzip
    import os

    with Scratch(spark) as scratch:
        captures = scratch.table("c", warc.write_archive(pages_of(spark), scratch.path("w"))).collect()
        root, records = scratch.path("w").removeprefix("file://"), []
        for r in captures:
            with open(f"{root}/{r.file}", "rb") as file:
                data = file.read()
            assert warc.parse_record(gzip.decompress(data[: min(c.offset for c in captures if c.file == r.file)]))[0]["WARC-Type"] == "warcinfo"
            records.append(warc.parse_record(gzip.decompress(data[r.offset : r.offset + r.length]))[0])
        assert len(os.listdir(root)) >= len({r.file for r in captures})
    responses = {f["WARC-Record-ID"]: f for f in records if f["WARC-Type"] == "response"}
    revisits = [f for f in records if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and all(responses[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] for f in revisits)


def test_warc_merged_and_broadcast_ways_agree(spark, monkeypatch):
    df = pages_of(spark)
    ways = []
    for bound in (0, 1_000):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        ways.append(sorted((tuple(r) for r in warc.with_revisits(df).collect()), key=str))
    assert ways[0] == ways[1] and len(ways[0]) == df.count()
