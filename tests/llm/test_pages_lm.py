import gzip
import json
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silt.llm import decontam, html, lbl, warc


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_lines_is_longest(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    got = [a[i] for i in html.common_lines(a, b)]
    assert len(got) == n[-1][-1]
    it = iter(b)
    assert all(x in it for x in got)


ARTICLE = (
    '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>'
    '<div class="ad">Buy</div><article><h1>Head &amp; <b>line</b></h1><p>One\n two<br>three<p>Four &eacute;</p>'
    '<aside>Related</aside><div class="comments"><p>me too</p></div></article><footer>&copy;</footer>'
)


def test_article(spark):
    rows = [(1, "http://a/x/1", ARTICLE), (2, None, None), (3, "http://b/", "plain &lt;text&gt;"), (4, "http://c", "<div>unclosed <p>a<p>b")]
    out = {r["page_id"]: r for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"] == "Head & line\nOne two three\nFour é"
    assert out[2]["text"] == "" and out[2]["n_chars"] == 0 and out[2]["url"] is None
    assert out[3]["text"] == "plain <text>" and out[4]["text"] == "unclosed\na\nb"


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div id="main-content" class="has-sidebar"><p>a</p><div class="sidebar">b</div></div><p>c</p>', "a"),
        ('<main><p>list</p><article><header><h1>t</h1></header><p>x</p><article class="comment">no</article></article></main>', "t\nx"),
        ('<div class="entry-content"><div class="post-header">t</div><p>x</p><div class="share-buttons">no</div></div><p>y</p>', "t\nx"),
        ('<body class="page"><div class="cookie-notice">no</div><form>no</form><p>x</p><p hidden>no</p><div style="display:none">no</div>', "x"),
        ("<p>a<b>b</b> c</p><table><tr><td>d<td>e</table><pre>f\n g</pre>", "ab c\nd\ne\nf g"), ("<p>x<!-- y --></p><script>z", "x"),
        ("<p>1 < 2 &lt; 3 &#233;&#x41; &nbsp;end", "1 < 2 < 3 éA end"), ("", ""),
    ],
)
def test_markup(page, want):
    assert "\n".join(html.differenced(html.parse(page))) == want


def test_differencing_removes_what_neighbours_share(spark):
    page = "<p>Welcome to the site</p><p>{0} has its own long story of {0} words to tell here</p><p>Bye now</p>"
    rows = [(i, f"http://h.example/a/{i:03d}", page.format(f"word{i}")) for i in range(60)]
    rows.append((99, "http://alone.example/", page.format("alone")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(df.repartition(7)).collect()}
    assert len(out) == 61 and all(out[i] == f"word{i} has its own long story of word{i} words to tell here" for i in range(60))
    assert out[99].startswith("Welcome to the site\nalone")


def test_copies_of_a_page_are_kept(spark):
    rows = [(i, f"http://h/{i}", "<p>all of this is the same</p><p>on both pages</p>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html.extract_main_text(df).collect()} == {"all of this is the same\non both pages"}


def test_copies_are_no_evidence_of_what_the_site_repeats():
    own = [f"<p>{w} is told at some length in this paragraph of the page</p>" for w in ("first", "second", "third")]
    site = "<p>Follow this site for more</p>"
    page = html.parse(site + "".join(own))
    copy = html.parse(site + "<p>Mirrored</p>" + "".join(own)).summary()
    others = [html.parse(site + f"<p>{w} and other stories are told elsewhere</p>").summary() for w in ("cats", "dogs")]
    assert len(html.differenced(page, [copy] * 4)) == 4
    assert html.differenced(page, [copy] * 4 + others) == [x for x in page.lines if x[:6] != "Follow"]


UNNAMED = (
    "<html><head><title>{i}</title></head><body><div><div><a>{menu}</a></div><div><a>Prices {menu}</a></div></div>"
    "<div><p>Join our list of readers</p></div>"
    "<section><h1>Story {i}</h1><p>{story}</p><p>Thanks for reading, please share it</p><p>{more}</p></section>"
    "<div><p>{menu} and {i} at the end</p></div></body></html>"
)


def _unnamed(rng, i):
    words = lambda n: " ".join(f"w{rng.integers(0, 500)}" for _ in range(n))
    own = {"story": words(30), "more": words(25)}
    return UNNAMED.format(i=i, menu=f"menu{rng.integers(0, 40)}", **own), "\n".join([f"Story {i}", own["story"], own["more"]])


def test_neighbours_tell_chrome_that_nothing_names(spark):
    rng = np.random.default_rng(5)
    pages = [_unnamed(rng, i) for i in range(40)]
    rows = [(i, f"http://h.example/{i % 3}/{i:02d}", page) for i, (page, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()}
    assert [out[i] for i in range(40)] == [want for _, want in pages]
    assert not any("\n".join(html.differenced(html.parse(page))) == want for page, want in pages)


def _sorted_hosts(rows):
    """(page_id, page, summary, neighbours) by brute force, in the order of host and path."""
    rows = sorted((re.match(r"\w+://([^/]*)(.*)", url).groups(), i, text) for i, url, text in rows)
    pages = [html.parse(text or "") for *_, text in rows]
    for k, ((host, path), i, _) in enumerate(rows):
        side = lambda of: [(rows[j][0][1], pages[j].summary()) for j in of if rows[j][0][0] == host]
        before = side(range(k - 1, max(-1, k - 1 - html.NEIGHBOURS), -1))
        after = side(range(k + 1, min(len(rows), k + 1 + html.NEIGHBOURS)))
        yield i, pages[k], pages[k].summary(), html.nearest(path, before, after)


@pytest.mark.parametrize("partitions", ["1", "4", "200"])
def test_pairing_over_random_hosts(spark, partitions, monkeypatch):
    monkeypatch.setattr(html, "LEAST_PAGES", 15)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):
        host, path = f"h{min(rng.integers(0, 9), 3)}", "/".join(str(x) for x in rng.integers(0, 3, 3))
        page = "".join(f"<p>line{rng.integers(0, 12)}</p>" for _ in range(rng.integers(0, 7)))
        rows.append((i, f"http://{host}/{path}?{i:03d}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = {r["page_id"]: r["text"] for r in html.extract_main_text(df.repartition(9)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == {i: "\n".join(html.differenced(page, near, own)) for i, page, own, near in _sorted_hosts(rows)}


def test_pages_of_the_small_table_without_their_neighbours(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    alone = beside = exact = 0
    for _, page, own, near in _sorted_hosts(rows):
        article = [x for x, z in zip(page.lines, page.zones) if z == html.ARTICLE]
        alone += html.differenced(page, [], own, names=False) == article
        beside += html.differenced(page, near, own, names=False) == article
        exact += html.differenced(page, near, own) == article
    assert exact == len(rows) and alone == 0 and beside > 0.8 * len(rows)


@pytest.mark.parametrize("start", ["<i x ", "<a x=\"", "<!x ", "<head>", "</script ", "<div>", "<p class=", "<a b='", "<i></b>"])
def test_unclosed_markup_is_read_in_linear_time(start):
    began = time.perf_counter()
    html.parse(start * (1_000_000 // len(start)))
    assert time.perf_counter() - began < 10


def test_page_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_main_text(none).count() == 0 and warc.build_derivatives(none).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", ARTICLE), (2, None, None), (3, "http://a/\r\nb", "<p>ü</p>"), (3, "http://a/\r\nb", "<p>ü</p>")]
    out = warc.build_derivatives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 4
    for r in out:
        html_ = next(h for i, _, h in rows if i == r["page_id"]) or ""
        (meta, mb), (conv, cb) = (next(warc.read_records(m)) for m in _members(bytes(r["records"])))
        meta, conv = dict(meta), dict(conv)
        assert meta["WARC-Refers-To"] == conv["WARC-Refers-To"] == r["refers_to"] == r["response_id"]
        assert conv["WARC-Source-Payload-Digest"] == warc.digest(html_.encode()) == r["payload_digest"]
        assert meta["WARC-Block-Digest"] == warc.digest(mb) and conv["WARC-Block-Digest"] == warc.digest(cb)
        assert cb.decode() == r["text"] and mb.decode() == r["metadata"]
        assert dict(r["http_headers"])["Content-Length"] == str(len(html_.encode()))
    assert len({r["conversion_id"] for r in out}) == 3
    both = b"".join(warc.write_record(h, b) for h, b in warc.derive(warc.response_record(1, "u", b"<p>x</p>")))
    assert [dict(h)["WARC-Type"] for h, _ in warc.read_records(gzip.compress(both))] == ["metadata", "conversion"]


def _members(data):
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        data = d.unused_data


def _response(url, http, payload, date="2023-05-06T07:08:09Z", **more):
    block = ("HTTP/1.1 404 Not Found\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n").encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{url}>"), ("WARC-Date", date), ("WARC-Target-URI", url), *more.items()]
    return warc.write_record([*headers, ("Content-Type", "application/http;msgtype=response")], block)


def test_warc_files(spark, tmp_path):
    page = "<html><title>Ä</title><p>größer &amp; <a href='/x'>weiter</a></p></html>"
    chunked = lambda b: b"".join(b"%x;q=1\r\n%s\r\n" % (len(b[i : i + 9]), b[i : i + 9]) for i in range(0, len(b), 9)) + b"0\r\n\r\n"
    latin, utf = page.encode("latin-1"), page.encode()
    bodies = {
        "plain": ([("Content-Type", "text/html; charset=ISO-8859-1")], latin),
        "meta": ([], b"<meta charset='latin-1'>" + latin),
        "gzip": ([("Content-Encoding", "gzip"), ("X-Odd", "1"), ("X-Odd", "2")], gzip.compress(utf)),
        "chunked": ([("Transfer-Encoding", "chunked"), ("Content-Encoding", "deflate")], chunked(zlib.compress(utf))),
        "broken": ([("Content-Encoding", "br")], utf), "none": ([], b""),
    }
    records = [_response(k, *v, Odd_Header="kept") for k, v in bodies.items()]
    records.insert(1, warc.write_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x:i>")], b"software: x"))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:4]))
    (tmp_path / "b.warc").write_bytes(b"".join(records[4:]))
    rows = warc.read_warc(spark, str(tmp_path))
    assert rows.count() == len(records)
    out = {r["url"]: r for r in warc.convert(rows).collect()}
    assert set(out) == set(bodies)
    for k, (http, payload) in bodies.items():
        r, meta = out[k], json.loads(out[k]["metadata"])
        assert r["refers_to"] == f"<urn:x:{k}>" and r["source_date"] == "2023-05-06T07:08:09Z" and r["payload_digest"] == warc.digest(payload)
        assert r["http_status"] == "HTTP/1.1 404 Not Found" and meta["http"]["headers"] == [list(x) for x in http]
        assert ["Odd_Header", "kept"] in meta["warc"] and meta["payload"].get("undecoded") == ("br" if k == "broken" else None)
        assert r["text"] == ("" if k == "none" else "größer & weiter"), k
    assert dict(out["gzip"]["http_headers"])["X-Odd"] == "1, 2"
    (tmp_path / "c.warc").write_bytes(b"".join(bytes(r["records"]) for r in out.values()))
    kinds = warc.read_warc(spark, str(tmp_path / "c.warc")).selectExpr("filter(headers, h -> h.name = 'WARC-Type')[0].value AS kind")
    assert {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()} == {"metadata": 6, "conversion": 6}
    assert warc.convert(rows.limit(0)).count() == 0


def test_warc_errors():
    with pytest.raises(ValueError):
        list(warc.read_records(b"nonsense\r\n"))
    with pytest.raises(ValueError):
        list(warc.read_records(warc.write_record([("WARC-Type", "response")], b"abc")[:-6]))


# Decontamination.

ITEMS = [
    (1, "If Alice buys 12 apples and each apple costs 3 dollars, how much money does Alice pay in total at the market?"),
    (2, "The quick brown fox jumps over the lazy dog while seven other animals watch it from the green hill."),
    (3, "too short"), (4, None), (5, ""),
]


def test_leaks(spark):
    filler = "Some words before that mean nothing at all here. "
    docs = [
        (10, filler + ITEMS[0][1] + " And after."),
        (11, filler + "If Robert buys 45 apples and each apple costs 8 dollars, how much money does Robert pay in total at the market? Yes."),
        (12, filler + "If Robert buys 45 apples and each apple costs 8 dollars, how much money does Susan pay in total at the market? Yes."),
        (13, filler + ITEMS[1][1].upper()), (14, filler * 10), (15, None), (16, ""), (10, filler + ITEMS[0][1] + " And after."),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(d, b).collect()}
    assert {(10, 1), (11, 1), (13, 2)} <= set(out) and (12, 1) not in out
    assert out[10, 1]["n_changed"] == 0 and out[11, 1]["n_changed"] >= 3
    assert sorted(r["doc_id"] for r in decontam.without_leaks(d, b).collect()) == [12, 14, 15, 16]
    assert decontam.leaks(d, b.limit(0)).count() == 0 and decontam.leaks(d.limit(0), b).count() == 0


def test_leaks_of_items_with_many_slots(spark):
    items = [
        (1, "A 12 kg box costs 30 dollars and a 5 kg box costs 14 dollars what is the difference"),
        (2, "If Alice pays 5 dollars, Bob pays 7 dollars, Carl pays 9 dollars and Dora pays 4 dollars, who pays most?"),
    ]
    docs = [(10 * i + n, "and so " + "word " * n + text + " then it ends") for i, text in items for n in range(4)]
    docs += [(99, "we saw " + " ".join(f"{k} and Xena" for k in range(40))), (98, " ".join(str(k) for k in range(60)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontam.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(10 * i + n, i) for i, _ in items for n in range(4)]


def _verdict(own, canon, met, met_canon):
    """Whether an alignment is a leak, and its equal pairs, by trying every stretch and run."""
    value = lambda t: (t[1:].rstrip(".,") if decontam.NAME <= t < decontam.AFTER else t) if t else t
    own, met = [value(t) for t in own], [value(t) for t in met]
    same = [x == y for x, y in zip(own, met)]
    eq = [x or (c == d) for x, c, d in zip(same, canon, met_canon)]
    n = len(own)
    best = max((sum(1 if x else -1 for x in eq[i:j]), j - i, j, i) for i in range(n) for j in range(i + 1, n + 1))
    low, high = best[3], best[2]
    slot = [decontam.NAME <= c < decontam.AFTER for c in canon]
    replaced = {(own[k], met[k]) for k in range(low, high) if slot[k] and eq[k]}
    need = min(decontam.MIN_MATCH, n)
    run = any(all(same[i : i + need]) for i in range(n - need + 1))
    ok = len({x for x, _ in replaced}) == len(replaced) or run
    return ok and sum(eq) >= need and sum(same) >= decontam.MIN_SAME, sum(eq)


def _brute_leaks(spark, docs, items):
    canonical = F.transform("own", decontam._canonical).alias("canon")

    def parsed(rows, name):
        df = spark.createDataFrame(rows, f"{name} long, text string")
        df = df.select(name, decontam.tokens(F.col("text"), "$0").alias("own"), decontam.tokens(F.concat(F.lit("a "), F.ltrim("text")), "$0").alias("within"))
        within = F.transform("within", decontam._canonical).alias("within")
        return [tuple(r) for r in df.select(name, "own", canonical, within).collect()]

    w, out = decontam.WINDOW, {}
    items = [x for x in parsed(items, "item_id") if x[1] and len(x[1]) >= w]
    for doc_id, own, canon, _ in parsed(docs, "doc_id"):
        for item_id, item_own, item_canon, within in items:
            n = len(item_own)
            for at in range(1 - n, len(own or [])):
                get = lambda of: [of[at + k] if 0 <= at + k < len(of) else None for k in range(n)]
                met = get(canon)
                hit = any(met[k : k + w] == item_canon[k : k + w] for k in range(n - w + 1)) or met[:w] == within[1 : w + 1]
                if hit:
                    leak, matched = _verdict(item_own, item_canon, get(own), met)
                    if leak:
                        out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), matched)
    return out


def _leaky(rng):
    """Items and documents that hold them after 0 to 7 words, whole or in part, with up to three words or slots changed."""
    vocabulary = [f"{x}{y}" for x in "bcdfg" for y in ("at", "en", "ill", "ost", "urn")]
    pick = lambda of: of[rng.integers(0, len(of))]

    def word():
        kind = rng.integers(0, 8)
        return pick(["Alice", "Bob", "Carl"]) if kind == 0 else f"{rng.integers(1, 9)}" if kind == 1 else "5 kg" if kind == 2 else pick(vocabulary)

    items = [(i, " ".join(word() for _ in range(rng.integers(8, 40))) + pick(["", ".", "?"])) for i in range(12)]
    docs = []
    for i in range(260):
        words = pick(items)[1].split(" ")
        if i % 3 == 0:
            a = rng.integers(0, len(words))
            words = words[a : a + rng.integers(8, 30)]
        for _ in range(i % 4):
            words[rng.integers(0, len(words))] = word()
        before, after = ([word() for _ in range(n)] for n in (i % 8, rng.integers(0, 12)))
        docs.append((i, " ".join([*before, *words, *after])))
    docs.append((900, " ".join(pick(vocabulary) for _ in range(700)) + " " + items[0][1] + " " + " ".join(pick(vocabulary) for _ in range(900))))
    return [*items, (50, items[3][1])], docs


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_brute_force(spark, seed):
    items, docs = _leaky(np.random.default_rng(seed))
    want = _brute_leaks(spark, docs, items)
    assert 100 < len(want) and {i for i, _ in want} < {i for i, _ in docs} and (900, 0) in want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        out = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontam.leaks(d.union(d.limit(40)), b, limit).collect()}
        assert out == want


def test_a_leak_is_judged_where_it_lies(spark):
    item = "alpha beta gamma 7 delta epsilon zeta eta theta 7 iota kappa lambda mu nu 9 xi omicron pi rho 7 sigma tau upsilon phi"
    words = item.split(" ")
    cut_off = " ".join(words[:17]) + " but the document goes on with 4 and 3 things of its own"  # 4 stands beside the item's 7
    clash = " ".join(["8" if k == 3 else x for k, x in enumerate(words)])  # one number edited, a long passage word for word
    other = " ".join({3: "1", 9: "2", 20: "3"}.get(k, x) for k, x in enumerate(words))
    d = spark.createDataFrame([(1, cut_off), (2, clash), (3, other)], "doc_id long, text string")
    out = decontam.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 2]


# Language model.


def test_counts_and_base_scores(odd_docs):
    rows = odd_docs.collect()
    tokens = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in rows]
    c = Counter(w for i, t in tokens if not lbl.held_out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(
        (i or -1, lbl.held_out(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens
    )
    out = lbl.score(odd_docs).collect()
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in out)


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    classes = 40 + lbl.RARE + 1
    flat = lbl.start_model(rng.integers(0, 50, classes).astype(float))
    flat += rng.normal(0, 0.2, flat.size).astype(np.float32)
    token = np.arange(classes)
    for one, two in ((classes, classes), (3, 100), (classes - 1, 7)):
        p = lbl.log_probabilities(flat, token, np.full(token.size, one), np.full(token.size, two))
        assert abs(np.exp(p).sum() - 1) < 1e-4


def test_training_texts_are_all_counted(spark):
    rows = [(i, "one word" if i % 3 else None) for i in range(2000)]
    n = sum((len((t or "").split()) + 1) for i, t in rows if not lbl.held_out(i))
    assert {r["train_tokens"] for r in lbl.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()} == {n}


def _alternating(n):
    rng = np.random.default_rng(1)
    return [(i, " ".join(f"{'ab'[i % 2]}{rng.integers(0, 30)}{'xy'[i % 2]}" for _ in range(120))) for i in range(n)]


def test_model_learns_and_beats_the_unigram(spark):
    out = lbl.score(spark.createDataFrame(_alternating(900), "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in out) > 0.9 * sum(r["base_score"] for r in out)


def test_scores_do_not_depend_on_the_layout(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(lbl, "PIECE_BYTES", 1 << 14)  # many pieces and rounds
    rows = odd_docs.union(spark.createDataFrame([(i, t, None, None, None) for i, t in _alternating(200)], odd_docs.schema))
    found = []
    for layout in (rows.coalesce(1), rows.repartition(7), rows.repartition(5, "text").sortWithinPartitions(F.col("doc_id").desc())):
        out = lbl.score(layout).collect()
        found.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in out))
    assert len(found[0]) == rows.count()
    for other in found[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(found[0], other, strict=True))


def test_more_text_helps(spark, monkeypatch):
    """The same held-out texts score better after a model of eight times the text."""
    monkeypatch.setattr(lbl, "PIECE_BYTES", 1 << 16)
    rows, gain = _alternating(1600), []
    for n in (200, 1600):
        out = lbl.score(spark.createDataFrame(rows[:n], "doc_id long, text string"), frequent=80).where("held_out and doc_id < 200")
        gain.append(out.selectExpr("avg(score / n_tokens)").first()[0])
    assert gain[1] > gain[0]


def test_scores_against_brute_force(spark):
    """A tiny corpus: the probability of each token by plain sums over all classes and words, from the trained model."""
    rows = _alternating(12) + [(50, "a1x never seen"), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = 8
    texts = {i: ((t or "").lower().split(), lbl.held_out(i)) for i, t in rows}
    c = Counter(w for words, held in texts.values() if not held for w in words)
    hash_of = lambda w: (int(lbl._words([w.encode()])[0][0]), int(lbl._words([w.encode()])[1][0]))
    top = sorted(c, key=lambda w: (-c[w], hash_of(w)[0]))[:frequent]
    klass = lambda w: top.index(w) if w in top else frequent + hash_of(w)[1]
    n_train = sum(not held for _, held in texts.values())
    about = np.zeros((2, lbl.RARE), np.int64)
    for w, n in c.items():
        about[:, hash_of(w)[1]] += (n, 1)
    packed = np.array([(hash_of(w)[0], c[w], hash_of(w)[1]) for w in top], lbl._COUNT)
    vocabulary = lbl.Vocabulary(about.tobytes() + packed.tobytes(), n_train, frequent)
    r, t, b, c1, c2 = lbl._views(lbl._model(df, vocabulary, 0))
    end = frequent + lbl.RARE
    for row in lbl.score(df, frequent=frequent).collect():
        words, _ = texts[row["doc_id"]]
        before, total = [end + 1, end + 1], 0.0
        for w in [*words, None]:
            k = end if w is None else klass(w)
            s = t @ (c1 * r[before[-1]] + c2 * r[before[-2]]) + b
            total += s[k] - math.log(np.exp(s.astype(float)).sum())
            if w is not None and k >= frequent:
                same = [x for x in c if klass(x) == k]
                total += math.log((c[w] + 1) / (sum(c[x] for x in same) + len(same) + 1))
            before.append(k)
        assert abs(row["score"] - total / math.log(10)) < 1e-3


def test_language_model_on_an_empty_table(no_docs):
    assert lbl.score(no_docs).count() == 0
