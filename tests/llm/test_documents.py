import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.llm import common, decontamination, fingerprints, html_extraction, toxicity

from .cases import edge_docs, edge_rows, empty_docs, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# -- contamination ---------------------------------------------------------------------------


def brute_contamination(rows, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = set()
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.add((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, prose(1, 120)[:300]), (2, "one TWO three"), (3, None), (4, " .. "), (10, "one two three"), (5, prose(2, 9000)[5000:5200])]


def found(df):
    return {tuple(r) for r in df.drop("text_key", "windows").collect()}


def test_contamination_edges(spark):
    assert found(decontamination.contamination(edge_docs(spark), benchmark(spark, ITEMS))) == brute_contamination(edge_rows(), ITEMS)
    assert found(decontamination.contamination(empty_docs(spark), benchmark(spark, ITEMS))) == set()
    none = benchmark(spark, [(1, None)])
    assert found(decontamination.contamination(edge_docs(spark), none)) == brute_contamination(edge_rows(), [(1, None)])


def test_contamination_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_NGRAMS", 0)
    assert found(decontamination.contamination(edge_docs(spark), benchmark(spark, ITEMS))) == brute_contamination(edge_rows(), ITEMS)


def test_contamination_on_the_table(spark, small):
    docs, items = (common.read_table(spark, small, t) for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(decontamination.contamination(docs, items)) == brute_contamination(rows, [tuple(r) for r in items.collect()])


def test_removal_of_documents_and_spans(spark):
    docs, items = edge_docs(spark), benchmark(spark, ITEMS)
    clean = {d for d, *_, hit in brute_contamination(edge_rows(), ITEMS) if not hit}
    kept = decontamination.remove_documents(docs, items)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns
    cut = decontamination.remove_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[3] is None and words(texts[6]) == [] and texts[10] == "a" * 3000
    before = {d: words(t) for d, t in edge_rows()}
    hits = {d: n for d, _, n, *_ in brute_contamination(edge_rows(), ITEMS)}
    assert all(len(words(texts[d])) == len(before[d]) - hits[d] for d in before)


def test_the_main_path_is_native(spark, small):
    docs, items = (common.read_table(spark, small, t) for t in ("documents", "benchmark"))
    plan = decontamination.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- toxicity --------------------------------------------------------------------------------


def toxic_rows(n=600):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.15
        text = prose(1000 + i, r.randint(10, 80))
        if bad:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(r.randrange(len(parts)), r.choice(["grobface", "snarlwit", "bilgehead"]))
            text = " ".join(parts)
        rows.append((i, text))
        if r.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_held_out_labels(spark):
    import zlib

    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, known).collect()}
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    held = [(out[i]["score"], y) for i, y in labels if out[i]["held_out"]]
    assert auc(held) > 0.95
    assert out[9000]["score"] == out[9001]["score"] < 0.3


def test_held_out_labels_do_not_matter(spark):
    import zlib

    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (sorted(map(tuple, toxicity.score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(edge_docs(spark), none)
    assert {r["score"] for r in out.collect()} == {0.0} and set(edge_docs(spark).columns) < set(out.columns)
    assert toxicity.score(empty_docs(spark), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_negative_risk_is_kept_from_zero():
    import numpy as np

    r = np.random.default_rng(0)
    positive = [np.unique(r.integers(0, 40, 6)).astype(np.int32) for _ in range(60)]
    other = [np.unique(np.append(r.integers(40, 90, 6), r.integers(0, 90, 1))).astype(np.int32) for _ in range(300)]
    weights, bias, corrected = toxicity.fit(toxicity.Sample(positive), toxicity.Sample(other), 0.1)
    score = lambda t: bias + sum(weights.get(int(x), 0) for x in t)
    assert np.mean([score(t) for t in positive]) > 0 > np.mean([score(t) for t in other])
    assert corrected > 0
    # A prior far below the share of positives among the unlabelled never needs the correction.
    assert toxicity.fit(toxicity.Sample(positive), toxicity.Sample([*other, *positive * 3]), 0.01)[2] == 0


def test_chosen_features_against_a_loop(spark):
    import numpy as np

    r = np.random.default_rng(3)
    positive = [np.unique(r.integers(0, 60, 12)).astype(np.int32) for _ in range(50)]
    other = [np.unique(r.integers(30, 400, 20)).astype(np.int32) for _ in range(200)]
    expected = []
    for f in range(400):
        p, u = sum(f in x for x in positive), sum(f in x for x in other)
        rate_p, rate_u = p / 50, (u + 0.5) / 201
        if p >= toxicity.MIN_POSITIVE_TEXTS and abs(rate_p - rate_u) / (rate_u * (1 - rate_u) / 50) ** 0.5 > 3:
            expected.append(f)
    assert toxicity.select(toxicity.Sample(positive), toxicity.Sample(other)).tolist() == expected
    assert toxicity.select(toxicity.Sample([]), toxicity.Sample(other)).tolist() == []
    rows = [(1, False, x) for x in positive[:20]] + [(1, True, x) for x in positive[20:]] + [(0, True, x) for x in other]
    table = spark.createDataFrame([(a, b, bytearray(x.tobytes())) for a, b, x in rows], "positive int, unlabelled boolean, features binary").repartition(5)
    assert toxicity.select_features(table).tolist() == toxicity.select(toxicity.Sample(positive), toxicity.Sample([*positive[20:], *other])).tolist() != []
    assert toxicity.select_features(table.limit(0)).tolist() == []


def test_all_words_of_long_texts_count(spark):
    """Signs at the far end of texts of many thousand words are learnt and found."""
    filler = lambda i: " ".join(f"w{(i * 7919 + k * 104729) % 40000}" for k in range(9000))
    rows = [(i, filler(i) + (" vile%d" % (i % 3) if i % 2 else " kind")) for i in range(80)]
    labels = [(i, i % 2) for i, _ in rows]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    toxic, clean = ([r["score"] for r in got if r["doc_id"] % 2 == k and r["held_out"]] for k in (1, 0))
    assert min(toxic) > max(clean)


def test_rejecting_keeps_columns_of_any_name(spark):
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame([(i, t, 7.5, "mine", True, 9) for i, t in rows], "doc_id long, text string, score double, predicted string, held_out boolean, n long")
    out = toxicity.reject_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == docs.columns
    got = out.collect()
    assert 0 < len(got) < len(rows) and {tuple(r[2:]) for r in got} == {(7.5, "mine", True, 9)}


# -- pages -----------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';if(a<b){}</script></head><body class='has-sidebar'>"
    "<header>Top</header><nav><ul><li>Home<li>About</ul></nav><div class='cookie-notice'>Cookies</div><div id=ad-1>Buy</div>"
    "<article><header><h1>Title &amp; more</h1></header><p>First  <b>bold</b>\n text<p>Second&nbsp;one<br>third</p>"
    "<table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul><form><input>Name</form><section class='comments'><p>Reader</p></section>5 &lt; 6 <!-- no --></article>"
    "<aside>Side</aside><footer>&copy; us</footer></body></html>"
)
PAGE_TEXT = "Title & more\nFirst bold text\nSecond one\nthird\n1 2\n3\nx\ny\n5 < 6"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "kept") for i, u, h in rows], "page_id long, url string, html string, _low string")


def test_extraction_edges(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "nonsense", ""), (4, "http://a.example/y", "<p>unclosed <b>text"), (1, "http://a.example/x", PAGE), (5, "u", "<script>never closed"), (6, "u", "plain & simple < text")]
    out = html_extraction.extract(pages(spark, rows))
    assert out.columns == ["page_id", "url", "_low", "text", "n_chars"]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect())
    expected = [(1, PAGE_TEXT), (1, PAGE_TEXT), (2, ""), (3, ""), (4, "unclosed text"), (5, ""), (6, "plain & simple < text")]
    assert got == [(i, t, len(t)) for i, t in expected]
    assert html_extraction.extract(pages(spark, [])).count() == 0


def test_repeated_branches_of_a_host_go(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div class=c1>Same words everywhere</div><div class=c2><p>{prose(i, 30)}</p></div></body>") for i in range(30)]
    rows += [(100, "https://other.example/", "<body><div class=c1>Same words everywhere</div></body>")]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, rows)).collect()}
    assert got[3] == " ".join(prose(3, 30).split()) and got[100] == "Same words everywhere"
    marked = html_extraction.importance(html_extraction.style_counts(pages(spark, rows))).collect()
    assert {round(r["importance"], 6) for r in marked if r["host"] == "other.example"} == {1.0}


def test_low_nodes_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "BROADCAST_NODES", -1)
    test_repeated_branches_of_a_host_go(spark)


def test_articles_of_the_table(spark, small):
    import html

    for r in html_extraction.extract(common.read_table(spark, small, "pages").selectExpr("*", "html as source")).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["source"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", inner)
        lines = (" ".join(html.unescape(re.sub(r"</?(b|i|a)\b[^>]*>", "", b)).split()) for b in blocks)
        assert r["text"] == "\n".join(x for x in lines if x)


# -- fingerprints ----------------------------------------------------------------------------


def brute_edited(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        k = len(t) // 4
        e = t[: len(t) - k] + rows[(i + 1) % len(rows)][1][:k]
        a, b, c = (fingerprints.chunk_weights(x) for x in (t, e, rows[(i + 1) % len(rows)][1]))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(a), fingerprints.fingerprint(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_edited_fingerprints_edges(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.edited_fingerprints(edge_docs(spark)).drop("containment_edited").collect()
        assert sorted(repr(tuple(r)) for r in got) == brute_edited(edge_rows())
        assert fingerprints.edited_fingerprints(empty_docs(spark)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_follow_the_bytes(spark, monkeypatch):
    """Documents of very different lengths: every document in one range, ranges in order, none far above the aim."""
    rows = [(i * 3, prose(i, 400 if i % 10 == 0 else 4)) for i in range(400)] + [(None, "null id"), (0, "again"), (7, None)]
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 20_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").fillna("", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        buckets = fingerprints.ordered_buckets(docs)
        found = [[(r["doc_id"], r["text"], r["bucket"]) for r in part if not r["tail"]] for part in buckets.rdd.glom().collect()]
        got = fingerprints.edited_fingerprints(docs).drop("containment_edited").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(len({r[2] for r in part}) == 1 for part in found)
    assert sorted(map(repr, (r[:2] for part in found for r in part))) == sorted(map(repr, ((d, t or "") for d, t in rows)))
    sizes = [sum(len(r[1]) for r in part) for part in found]
    assert max(sizes) < 2 * 20_000 and len(sizes) >= sum(sizes) / 20_000 / 2
    assert sorted(repr(tuple(r)) for r in got) == brute_edited(rows)


def test_many_edges_are_looked_up():
    import numpy as np

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    edges = sorted({int(x) for x in np.random.default_rng(2).integers(-500, 500, 130)})
    rows = spark.range(-600, 600).select("id", fingerprints._range_of(F.col("id"), edges).alias("r")).collect()
    assert [r["r"] for r in sorted(rows)] == [sum(e < i for e in edges) for i in range(-600, 600)]


def test_gear_hashes_against_the_loop():
    import numpy as np

    data = np.frombuffer(prose(3, 60).encode(), dtype=np.uint8)
    h, out = 0, []
    for b in data.tolist():
        h = (h * 2 + int(fingerprints.GEAR[b])) % 2**32
        out.append(h)
    assert fingerprints.gear_hashes(data).tolist() == out


def test_chunks_survive_a_shift():
    text = prose(5, 2000)
    a, b = fingerprints.chunk_weights(text), fingerprints.chunk_weights("inserted words here " + text)
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.containment(a, b) > 0.9
    assert fingerprints.likeness(a, fingerprints.chunk_weights(prose(6, 2000))) < 0.05
    ends = fingerprints.chunk_ends(text.encode())
    assert ends[-1] == len(text.encode()) and all(0 < y - x <= fingerprints.MAX_CHUNK for x, y in zip([0, *ends], ends, strict=False))


# -- the style tree --------------------------------------------------------------------------


def test_the_tree_alone_removes_what_repeats(spark):
    """Without names and article elements: menus, adverts and footers of hosts with enough pages go."""
    rows, menus = [], [[f"menu{k}{x}" for x in "abcd"] for k in range(12)]
    for i in range(80):
        menu = "".join(f"<li><a href=/x>{w}</a></li>" for w in menus[i * 7 % 12][: 3 + i % 2])
        body = f"<div class=x1><h2>{prose(500 + i, 4)}</h2><p>{prose(i, 40)}</p><p>{prose(i + 200, 30)}</p></div>"
        rows.append((i, f"https://h.example/{i}", f"<body><div class=m><ul>{menu}</ul></div><div class=a2>{prose(900 + i % 9, 8)}</div>{body}<div class=f>{prose(700 + i % 10, 5)}</div></body>"))
    flat = lambda t: " ".join(t.split())
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, rows), names=False).collect()}
    assert got == {i: "\n".join(map(flat, (prose(500 + i, 4), prose(i, 40), prose(i + 200, 30)))) for i in range(80)}


def test_the_tree_on_the_table(spark):
    """Names off: as with names on at least nine pages of ten."""
    table = common.read_table(spark, "/root/testdata/sf0.1", "pages")
    with_, alone = ({r["page_id"]: r["text"] for r in html_extraction.extract(table, names=n).select("page_id", "text").collect()} for n in (True, False))
    assert sum(with_[k] == alone[k] for k in with_) >= 0.9 * len(with_)


def test_deep_pages_need_linear_room():
    import tracemalloc

    deep = "<div>" * 100_000 + "inside" + "</div>" * 100_000
    tracemalloc.start()
    page = html_extraction.Page(deep)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert page.text() == "inside" and peak < 120e6
    assert html_extraction.Page("<div>" * 50_000 + "open").text() == "open"


def cut_hosts(sizes):
    """Pages of the table on hosts of a few pages each, with one page that repeats a line a thousand times, and with copied articles."""
    import collections
    import urllib.parse

    import pyarrow.parquet as pq

    hosts = collections.defaultdict(list)
    for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        hosts[urllib.parse.urlsplit(r["url"]).netloc.lower()].append(r["html"])
    article = re.compile(r"<article.*?(?:</article>|<footer>|$)", re.S)
    for k in sizes:
        for host, found in sorted(hosts.items())[::3]:
            some = found[:k]
            yield from ((f"https://k{k}.{host}/", h) for h in some)
            yield f"https://r{k}.{host}/", some[0].replace("</article>", "<p>Same line.</p>" * 1000 + "</article>", 1)
            yield from ((f"https://r{k}.{host}/", h) for h in some[1:])
            articles = [article.search(h)[0] for h in some]
            yield from ((f"https://c{k}.{host}/", article.sub(lambda m, n=n, a=articles: a[n // 3 % len(a)], h, count=1)) for n, h in enumerate(found[: 3 * k]))


def test_no_article_is_lost_on_hosts_of_any_size(spark):
    import collections

    rows = [(i, u, h) for i, (u, h) in enumerate(cut_hosts((1, 2, 5, 9, 12, 20)))]
    with_, alone = ({r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, rows), names=n).collect()} for n in (True, False))
    kept, precise, whole = 0, 0, 0
    for i, _, h in rows:
        text = html_extraction.Page(h).text()
        assert with_[i] == text
        a, b = (collections.Counter(t.split()) for t in (text, alone[i]))
        both = sum((a & b).values())
        assert both >= 0.95 * sum(a.values()), i
        whole, kept, precise = whole + sum(a.values()), kept + both, precise + sum(b.values())
    assert kept >= 0.99 * whole and kept >= 0.85 * precise


def test_the_tree_finds_what_names_do_not_know(spark):
    """Names on, classes that say nothing: boxes beside the article that repeat go, on a host of four pages too."""
    for n in (4, 30):
        rows = [(i, "https://h.example/", f"<body><div class=q7>{prose(i, 40)}<div>{prose(50 + i, 20)}</div></div><div class=z3>Our offers of the week</div><div class=z4>{prose(90 + i % 2, 12)}</div></body>") for i in range(n)]
        got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, rows)).collect()}
        assert "offers" in html_extraction.Page(rows[0][2]).text() and not any("offers" in t for t in got.values())
        assert all(" ".join(prose(i, 40).split()) in got[i] for i in range(n))


def test_copies_of_one_page_are_no_evidence(spark):
    """Twenty pages with one article: nothing tells what is boilerplate, so all of it stays."""
    rows = [(i, "https://h.example/", f"<body><div class=q7>{prose(1, 40)}<div>more {i}</div></div><div class=z3>beside it</div></body>") for i in range(20)]
    got = html_extraction.extract(pages(spark, rows)).collect()
    assert all(r["text"].endswith("beside it") and f"more {r['page_id']}" in r["text"] for r in got)
