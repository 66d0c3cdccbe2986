import random
import re
from dataclasses import replace

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import common, html_extraction, license_scan, neighbours, sentencepiece_codec, url_filters


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def texts(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit("clash"))
    return {r.page_id: r.text for r in html_extraction.extract(df, **kw).collect()}


def test_article_alone_is_kept(spark):
    rows = [
        (1, "http://a.b/1", page("<nav>menu</nav><article><h1>Head &amp; more</h1><p><b>One<br><p>Two  \n x</p><aside>no</aside><form>no</form>"
                                 "<div class='comments'>no</div></article><div class='ad'>no</div><footer>&copy; no</footer>")),
        (2, None, None), (3, "", ""), (4, "http://a.b/2", page("<main><p>in main</p></main><p>out</p>")),
        (5, "http://a.b/3", page("<p>no article &lt;b&gt; &amp here<ul><li>a<li>b</ul>")),
        (6, "http://a.b/4", "<article><p>cut off & done"),
    ]
    got = texts(spark, rows)
    assert got == {1: "Head & more One Two x", 2: "", 3: "", 4: "in main", 5: "no article <b> & here a b", 6: "cut off & done"}


def test_site_template_goes_and_quoted_passages_stay(spark):
    def one(i):
        return page(f"<div><p>Site wide words</p><p>and {'promo'}</p></div><div><p>Own text {i}</p></div>")

    rows = [(i, f"http://one.site/{i}", one(i)) for i in range(12)]
    rows += [(100 + i, f"http://other.site/{i}", one(i)) for i in range(2)]
    rows += [(200 + i, f"http://news.site/{i}", page(f"<article><p>Quoted passage.</p><div class=x>Read on</div><p>Story {i}</p></article>")) for i in range(12)]
    rows += [(300 + i, "http://copies.site/same", page("<div><p>Same page again</p></div>")) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == f"Own text {i}" for i in range(12))
    assert all(got[100 + i] == f"Site wide words and promo Own text {i}" for i in range(2))
    assert all(got[200 + i] == f"Quoted passage. Story {i}" for i in range(12))
    assert all(got[300 + i] == "Same page again" for i in range(12))
    assert texts(spark, rows, broadcast_subtrees=0) == got


def test_copies_and_size_of_a_host_hide_no_template(spark):
    notice = "<div><p>Site wide words</p></div>"
    rows = [(i, f"http://copies.site/{i}", page(f"{notice}<div><p>Own text {i % 6}</p></div>")) for i in range(660)]
    rows += [(1000 + i, f"http://large.site/{i}", page(f"{notice if i < 8 else ''}<div><p>Own text {i}</p></div>")) for i in range(850)]
    for broadcast in (1000, 0):
        got = texts(spark, rows, broadcast_subtrees=broadcast, enough_pages=8)
        assert all(got[i] == f"Own text {i % 6}" for i in range(660) if i % 6)
        assert all(got[1000 + i] == f"Own text {i}" for i in range(850))


def test_articles_in_marked_or_unclosed_places():
    def text(html):
        root = html_extraction.parse(html)
        html_extraction.hash_subtrees(root)
        return html_extraction.text_of(root)

    assert text('<body class="home has-sidebar"><article><p>Hello</p></article></body>') == "Hello"
    assert text("<html><head><title>T</title><body><p>Hello</p></body></html>") == "Hello"
    assert text("<html><head><title>T</title><p>Hello") == "Hello"
    assert text("<head><meta x>Hello") == "Hello"
    assert text('<article><div class="article-header"><h1>Title</h1></div><p>Text</p><div class="site-footer">no</div></article>') == "Title Text"
    assert text('<article class="post with-banner">Text<article class="comment">no</article></article>') == "Text"
    assert text('<main class="page-sidebar"><p>Text</main><div class="sidebar">no</div>') == "Text"
    assert text('<p>Text<div class="no-ads">more</div><div class="ad-slot">no</div>') == "Text more"


def test_names_alone_drop_no_prose_and_no_main_is_lost():
    def text(html):
        root = html_extraction.parse(html)
        html_extraction.hash_subtrees(root)
        return html_extraction.text_of(root)

    prose = " ".join(f"word{i}" for i in range(30))
    assert text(f'<article class="post ad-free"><p>{prose}</p></article>') == prose
    assert text(f'<article><div class="related-work">{prose}</div><section id="social-history">{prose}</section></article>') == f"{prose} {prose}"
    assert text(f'<article><p>{prose}</p><div class="related-posts"><a href=x>{prose}</a></div><div class="related-stories">few words</div></article>') == prose
    assert text(f'<article><p>{prose}</p><div class="user-comments"><p>{prose}</p></div><div class="ad-slot">{prose}</div></article>') == prose
    assert text("<main><p>one</p></main><nav>no</nav><main><p>two</p></main>") == "one two"
    assert text("<main><h1>Title</h1><p>Lead</p><article>Body</article><aside>no</aside></main>") == "Title Lead Body"
    assert text("<article>a<main>b</main></article><article>c</article>") == "a b c"


def test_deep_and_long_pages_take_linear_work():
    import time

    def seconds(n):
        start = time.process_time()
        root = html_extraction.parse("<p>" + "<b>x" * n + "<div>y</div>" * n + "</b>" * n + "</i>" * n)
        html_extraction.hash_subtrees(root)
        assert html_extraction.text_of(root).count("y") == n
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.01)


def brute_templates(rows, least):
    """(host, subtree) counted with dictionaries: different main texts under which an element stands."""
    seen = {}
    for _, url, html in rows:
        root = html_extraction.parse(html or "")
        own = {h for h, _ in html_extraction.hash_subtrees(root)}
        for h in own:
            seen.setdefault((url.split("/")[2], h), set()).add(html_extraction.main_hash(root))
    return {k for k, v in seen.items() if len(v) >= least}


def test_counting_matches_brute_force(spark):
    rng = random.Random(9)
    blocks = [f"<div class=b{i}><p>Block {i}</p></div>" for i in range(12)]
    rows = []
    for i in range(120):
        parts = rng.sample(blocks, 3)
        body = f"<div>Own words {i % 90}</div>"
        whole = parts[0] + (f"<article>{body}{parts[1]}</article>" if i % 2 else body + parts[1]) + parts[2]
        rows.append((i, f"http://h{i % 4}.x/{i}", page(whole)))
    template = brute_templates(rows, html_extraction.MIN_PAGES)
    got = texts(spark, rows)
    changed = 0
    for i, url, html in rows:
        root = html_extraction.parse(html)
        html_extraction.hash_subtrees(root)
        own = frozenset(h for host, h in template if host == url.split("/")[2])
        assert got[i] == html_extraction.text_of(root, own)
        changed += got[i] != html_extraction.text_of(root)
    assert changed > 60


def test_no_pages(spark):
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(-(len(h) + len(p)), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules_match_brute_force(spark):
    rng = random.Random(2)
    rules = [*url_filters.RULES, ("block", "a.example.net", "/en/x"), ("allow", "net", "/en/x/y"), ("block", "net", "/en/x/y")]
    urls = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.example.net/en/xyz?q=/de/", "ftp://x.org/fr/#/en/", "http://é.net/"]
    for _ in range(300):
        urls.append("http://" + ".".join(rng.choices(["a", "b", "example", "net", "com", "org", ""], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/de/1", "/fr/x", "/en/x/y/z", "?x", "#y", "/en"]))
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(None, "http://net/", "c"), (3, "http://net/", "c")], "page_id long, url string, rule string")
    got = url_filters.filter_urls(df, url_filters.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 2
    mine = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got if r.page_id != 3}
    assert all(mine[i] == brute_verdict(u, rules) for i, u in enumerate(urls) if i != 3)
    assert url_filters.filter_urls(df.limit(0), url_filters.rule_table(spark, rules)).count() == 0
    # one hex digit makes strangers meet; whole digests part them
    clash = url_filters.filter_urls(df, url_filters.rule_table(spark, rules), digest_hex=1).collect()
    assert sorted(map(str, clash)) == sorted(map(str, got))
    no_rules = url_filters.filter_urls(df, url_filters.rule_table(spark, []))
    assert {r.verdict for r in no_rules.collect()} == {"allow"} and no_rules.count() == len(urls) + 2


def test_a_long_url_and_the_query_itself(spark, tmp_path):
    urls = ["http://" + "a." * 50_000 + "net/" + "x/" * 50_000, "http://b.example.net/en/1", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.op8_url_filters(spark, str(tmp_path)).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: (None, "allow")}
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(map(str, con.sql(url_filters.ORACLE_SQL).fetchall()))
    mine = url_filters.op8_url_filters(spark, "/root/testdata/sf0.001").select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in mine) == want


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[::7] = x[3] + 0.3 * rng.standard_normal((len(x[::7]), 24)).astype(np.float32)
    x[100:140] = x[100]
    bad = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [None] * 24), (9004, [1.0]), (None, [1.0] * 24)]
    got = {}
    for r in neighbours.search(vectors(spark, x, bad), block=400).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries = [i for i in range(1500) if i % 20 == 0]
    assert sorted(got) == queries
    hit = 0
    d = x.astype(float)
    for q in queries:
        s = (d * d[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        found = [got[q][k][0] for k in range(1, 21)]
        assert [got[q][k][1] for k in range(1, 21)] == pytest.approx(s[found], abs=1e-12)
        assert found == sorted(found, key=lambda i: (-s[i], i))
        hit += len(set(found) & set(order))
    assert hit / (20 * len(queries)) >= 0.9


def test_few_or_no_vectors(spark):
    got = neighbours.search(vectors(spark, np.eye(4, dtype=np.float32))).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert neighbours.search(vectors(spark, np.zeros((0, 4)))).count() == 0


def test_pigeonhole_finds_all_codes_within_the_radius():
    rng = np.random.default_rng(6)
    code = rng.integers(0, 2**16, (500, 3)).astype(np.uint16)
    code[250:] = code[:250] ^ (np.uint16(1) << rng.integers(0, 16, (250, 3)).astype(np.uint16))
    index = neighbours.Index(np.arange(500), np.zeros((500, 1)), code)
    distance = neighbours._hamming(code[:40], code)
    for radius in (0, 1, 2, 3, 7, 20):
        assert list(map(tuple, np.argwhere(distance <= radius))) == list(zip(*index.within(code[:40], radius), strict=True))


def test_probes_take_values_in_the_order_of_their_places():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 20))
    codes = neighbours.fit_codes(x, 5, rotations=2)  # 40 bits: the third substring is filled up
    assert sorted(codes.flips) == list(range(1 << 16)) and codes.of(x).shape == (300, 3)
    values, code = replace(codes, probes=1 << 16).values(x[:4]), codes.of(x)
    for i in range(4):
        first = [min(int(np.flatnonzero(values[i, t] == code[j, t])[0]) for t in range(3)) for j in range(40)]
        assert first == codes.place(np.repeat(x[i : i + 1], 40, axis=0), x[:40]).tolist() and first[i] == 0


def test_tables_of_the_index_prune_and_keep_true_neighbours():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = neighbours.fit_codes(x[:6000], 20)
    scores = x[6000:6200] @ x.T
    scores[np.arange(200), 6000 + np.arange(200)] = -2
    near = np.argsort(-scores, axis=1)[:, :20]
    asked = np.repeat(x[6000:6200], 20, axis=0)
    among_all = codes.tuned(codes.place(asked, x[near.ravel()]), neighbours._distance(codes, asked, x[near.ravel()]), 0.97)
    assert among_all.probes < codes.probes and among_all.radius < codes.radius  # of more rows the nearest lie nearer
    index = neighbours.Index(np.arange(20_000), x, codes.of(x))
    q = np.arange(40)
    values, word = among_all.values(x[q]), codes.of(x[q]).view("<u8")
    passed = sum(len(index.near(values[i], word[i], 256)) for i in q)  # a radius of all bits: what the tables alone give
    scored = sum(len(index.near(values[i], word[i], among_all.radius)) for i in q)
    assert passed < 0.3 * 40 * 20_000 and scored < 0.08 * 40 * 20_000
    found = {(a, b) for a, b, _ in index.search(q, x[q], among_all, 20)}
    best = np.argsort(-(x[q] @ x.T), axis=1)[:, 1:21]
    assert sum((i, int(j)) in found for i in q for j in best[i]) >= 0.94 * 800


def test_search_goes_on_where_probes_give_too_few():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((60, 32))
    codes = replace(neighbours.fit_codes(x, 5), probes=1, radius=0)
    index = neighbours.Index(np.arange(60), x, codes.of(x))
    assert [a for a, _, _ in index.search(np.arange(3), x[:3], codes, 10)] == [0] * 10 + [1] * 10 + [2] * 10
    got = index.search(np.arange(1), x[:1], codes, 100)
    assert [b for _, b, _ in got] == sorted(range(1, 60), key=lambda j: (-(x[j] * x[0]).sum(), j))


@pytest.fixture(scope="module")
def codecs():
    path = public_tokenizers.path(sentencepiece_codec.MODEL)
    return (sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.MergeCodec(path),
            sentencepiece_codec.MergeCodec(path, 0.3, 5))


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(), st.text(alphabet="ab e\n▁é日🎉 ", max_size=30)))
def test_codec_equals_library_and_round_trips(codecs, text):
    library, plain, dropping = codecs
    if "▁" not in text and "\0" not in text:
        assert plain.encode(text) == library.encode(text)
    assert plain.decode(plain.encode(text)) == text
    assert dropping.decode(dropping.encode(text, 1)) == text


def test_dropout_varies_by_key_and_not_by_run(codecs):
    text = "the international organisation of extraordinary measurements " * 5
    _, plain, dropping = codecs
    assert dropping.encode(text, 1) == dropping.encode(text, 1)
    assert len({tuple(dropping.encode(text, k)) for k in range(6)}) > 3
    assert len(dropping.encode(text, 1)) > len(plain.encode(text))


def brute_ids(codec, part, number, key, floor):
    """Merge by rescanning all neighbours each time; the draw of a candidate in plain integers."""
    bits = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & bits
        x = (x ^ x >> 27) * 0x94D049BB133111EB & bits
        return x ^ x >> 31

    odd = 0x9E3779B97F4A7C15
    own = mix(number * odd + key & bits)

    def skipped(left, length):
        return mix(own + (left * codec.stride + length + 1) * odd & bits) < floor

    symbols = list(part)
    while True:
        found, at = [], 0
        for i, (x, y) in enumerate(zip(symbols, symbols[1:])):
            if x + y in codec.cost and not skipped(at, len(x + y)):
                found.append((codec.cost[x + y], i))
            at += len(x)
        if not found:
            return codec._ids(symbols)
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_dropout_matches_brute_force(codecs):
    rng = random.Random(3)
    path = public_tokenizers.path(sentencepiece_codec.MODEL)
    words = ["extraordinary", "organisation", "measurements", "the", "aaaaaaaa", "papapapapa", "日本", "🎉x", "x" * 70, "Über", "a"]
    for dropout in (0.1, 0.5):
        codec = sentencepiece_codec.MergeCodec(path, dropout, 13)
        for key in range(4):
            text = " ".join(rng.choices(words, k=120))
            parts = [sentencepiece_codec.SPACE + w for w in text.split(" ")]
            want = [i for k, part in enumerate(parts) for i in brute_ids(codec, part, k + 1, codec._key(str(key)), int(dropout * 2**64))]
            assert codec.encode(text, key) == want
            assert codec.encode_batch([text, "", "a b", text], [key, 9, 9, key + 1])[0].tolist() == want


def test_every_occurrence_draws_its_own_dropout(codecs):
    codec = sentencepiece_codec.MergeCodec(public_tokenizers.path(sentencepiece_codec.MODEL), 0.1, 13)
    ids = codec.encode("measurements " * 4000, 1)
    ways, now = [], []
    for i in ids:
        if codec.pieces[i].startswith(sentencepiece_codec.SPACE) and now:
            ways.append(tuple(now))
            now = []
        now.append(i)
    assert len(set(ways)) > 8 and ways[:16] != ways[16:32]
    skips = codec._skips(common.mix(np.arange(200_000, dtype=np.uint64)), np.full(200_000, 77))
    assert abs(skips.mean() - 0.1) < 0.005


def test_the_pair_table_knows_every_split(codecs):
    ids = codecs[1].id
    rng = random.Random(1)
    for piece in rng.sample(sorted(ids), 2000):
        for i in range(1, len(piece)):
            left, right = ids.get(piece[:i]), ids.get(piece[i:])
            if left is not None and right is not None:
                assert codecs[1].merged(np.array([left]), np.array([right])).tolist() == [ids[piece]]
    pairs = np.random.default_rng(2).choice(list(ids.values()), (20_000, 2))
    want = [ids.get(codecs[1].pieces[a] + codecs[1].pieces[b], -1) for a, b in pairs]
    assert codecs[1].merged(pairs[:, 0], pairs[:, 1]).tolist() == want


def test_codec_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a ▁ b"), (3, "x" * 50_000), (3, "x" * 50_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d.doc_id), d.text or "") for d in docs.collect())


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        (1, "a/b/x.c", False, "int main"), (2, "a/LICENSE", True, "Released under the MIT License."),
        (3, "LICENSE", True, "Licensed under the Apache\nLicense, Version 2.0."), (4, "c/d.c", False, "foo"),
        (5, "a/b/y.c", None, "x\nAll rights reserved.\ny"), (6, None, None, None), (7, "top.c", False, None), (7, "top.c", False, None),
        (None, "a/b/c/d/e.c", False, ""), (8, "a/z.c", False, "this long line of prose only mentions the MIT License once among many other words"),
    ]
    df = spark.createDataFrame(rows, "file_id int, path string, is_license_file boolean, text string").withColumn("dir", F.lit("clash"))
    got = license_scan.scan(df).collect()
    by = {r.file_id: (r.own_license, r.license, r.license_from, r.distance) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (None, "MIT", "a/LICENSE", 1) and by[2] == ("MIT", "MIT", None, None)
    assert by[3][0] == "Apache-2.0" and by[4] == (None, "Apache-2.0", "LICENSE", 1)
    assert by[5][:2] == ("all-rights-reserved",) * 2 and by[6] == (None, None, None, None)
    assert by[7] == (None, "Apache-2.0", "LICENSE", 0) and by[None] == (None, "MIT", "a/LICENSE", 3)
    assert by[8] == (None, "MIT", "a/LICENSE", 0)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_cosine_equals_a_dictionary_version():
    templates = license_scan.TEMPLATES
    matcher = license_scan.Matcher(templates, {"the": 50, "mit": 3, "license": 9}, 100)

    def weight(t):
        return matcher.idf[matcher.terms[t]] if t in matcher.terms else matcher.other

    def cosine(line, template):
        a, b = [license_scan.TOKEN.findall(x.lower().replace("\n", " ")) for x in (line, template)]
        known = {t: a.count(t) * weight(t) for t in set(a) if t in matcher.terms}
        norm = sum(v * v for v in known.values()) + sum(matcher.other**2 for t in a if t not in matcher.terms)
        ref = {t: b.count(t) * weight(t) for t in set(b)}
        return sum(v * ref.get(t, 0) for t, v in known.items()) / np.sqrt(norm * sum(v * v for v in ref.values()))

    assert np.allclose(matcher.blocks(matcher.codes("the\nmit\n\nof things\n \n\nlicense")), [[cosine(x, t) if x else 0 for _, t in templates] for x in ("the mit", "of things", "", "license")])
    lines = ["Released under the MIT License.", "the the mit of things", "All rights are reserved to the public license"]
    got = matcher.lines(matcher.codes("\n".join(lines)))
    assert np.allclose(got, [[cosine(x, t) for _, t in templates] for x in lines])


def test_licence_texts_are_found_whole_and_as_headers(spark):
    wording = dict(license_scan.TEMPLATES[5:])
    rows = [(i, f"p{i}/COPYING", None, f"Copyright (c) 2020 Some One\n\n{t}\n") for i, t in enumerate(wording.values())]
    rows += [(100 + i, f"p{i}/a/b.c", None, "int main") for i in range(len(wording))]
    rows += [(200 + i, f"q{i}/x.c", None, "\n".join(f" * {x}" for x in t.split("\n")) + "\n\n" + "int main code here\n" * 300) for i, t in enumerate(wording.values())]
    rows += [(300 + i, f"q{i}/y.c", None, "other words") for i in range(len(wording))]
    got = {r.file_id: r for r in license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, is_license_file boolean, text string")).collect()}
    for i, name in enumerate(wording):
        assert got[i].own_license == got[200 + i].own_license == got[100 + i].license == name and got[100 + i].distance == 1
        assert got[300 + i].license is None  # a header speaks of its own file


def test_inheritance_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    notices = [t for _, t in license_scan.TEMPLATES[:5]]
    rows = [(i, rng.choice(["words only", "some\n" + rng.choice(notices)]) if i % 8 == 0 else rng.choice(["plain", "", None]), "en", "web") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in license_scan.op5_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    givers = {}
    for r in got.values():
        assert r.is_license_file or "LICENSE" not in r.path
        if r.is_license_file and r.own_license:
            givers.setdefault(r.path.rsplit("/", 1)[0], []).append((-r.own_score, r.path, r.own_license))
    used = set()
    for r in got.values():
        want = (r.own_license, None, None)
        folder = r.path.rsplit("/", 1)[0].split("/")
        for up in range(len(folder) + 1) if r.own_license is None else ():
            best = min(givers.get("/".join(folder[: len(folder) - up]), []), default=None)
            if best:
                want = (best[2], best[1], up)
                break
        assert (r.license, r.license_from, r.distance) == want
        used.add(r.distance)
    assert {None, 1, 2} <= used


def test_verdicts_do_not_hang_on_the_number_of_files():
    lines = [
        "This file is licensed under the Apache License, Version 2.0.", "(c) All rights reserved.", "Released under the MIT License.",
        "this long line of prose only mentions the MIT License once among many other words",
    ]
    share = {"the": 0.8, "is": 0.6, "this": 0.5, "under": 0.2, "all": 0.3, "work": 0.2, "by": 0.5, "version": 0.05, "public": 0.1}
    for files in (10**3, 10**5, 10**7):
        matcher = license_scan.Matcher(license_scan.TEMPLATES, {t: int(files * share.get(t, 0.02)) for t in license_scan.Matcher(license_scan.TEMPLATES, {}, 1).terms}, files)
        found = matcher.lines(matcher.codes("\n".join(lines)))
        said = [matcher.names[r.argmax()] if r.max() >= license_scan.MATCH_AT else None for r in found]
        assert said == ["Apache-2.0", "all-rights-reserved", "MIT", None]
