"""Full-text search against hand-worked ranks and a brute force over all stretches of a text."""

import random
import re
import unicodedata

import pytest

from quirework.operators import fulltext

WORD = re.compile(r"[^\W_]+")


def lexemes(text):
    out = []
    for w in WORD.findall(text or ""):
        w = fulltext.fold_word(w.lower())
        out.append("" if w in fulltext.STOP_WORDS else fulltext.stem_word(w))
    return out


def satisfied(words, alternatives, open_):
    """Whether a stretch of words satisfies an alternative that is open to its text."""

    def occurs(p):
        return any(all(i + s < len(words) and words[i + s] == w for w, s in zip(p.stems, p.steps)) for i in range(len(words)))

    return any(o and all(occurs(p) for p in a.wanted) for a, o in zip(alternatives, open_))


def brute(text, query, fold_query=False):
    """None, or (rank, covers): every stretch from one word of the query to another is tried."""
    lex, alternatives = lexemes(text), fulltext.parse(query, fold_query)
    stems = {s for a in alternatives for p in (*a.wanted, *a.unwanted) for s in p.stems}
    occurs = lambda p: satisfied(lex, [fulltext.Conjunction((p,), ())], [True])
    open_ = [not any(occurs(p) for p in a.unwanted) for a in alternatives]
    if not satisfied(lex, alternatives, open_):
        return None
    at = [i for i, w in enumerate(lex) if w in stems]
    good = [(b, e) for b in at for e in at if b <= e and satisfied(lex[b : e + 1], alternatives, open_)]
    covers = [(b, e) for b, e in good if not any((x, y) != (b, e) and b <= x and y <= e for x, y in good)]
    rank = sum(0.1 / (1 + (e - b + 1) - sum(b <= i <= e for i in at)) for b, e in sorted(covers))
    return rank, sorted(covers)


def brute_headline(text, query, covers):
    """The best of the windows that the covers propose, out of all windows of the text."""
    lex, n = lexemes(text), len(lexemes(text))
    alternatives = fulltext.parse(query)
    stems = {s for a in alternatives for p in (*a.wanted, *a.unwanted) for s in p.stems}
    spans = [m.span() for m in WORD.finditer(text)]
    good = [b - a > 3 or w in stems for (a, b), w in zip(spans, lex)]
    best = None
    for b, e in covers:
        windows = [(s, t) for s in range(n) for t in range(s, n) if t - s < 35 and (s == b or (s < b and t - s + 1 == 12) or (s < b and s == 0 and t - s < 12))]
        top = min(b + 34, n - 1)
        if e - b + 1 >= 35:
            ends = [t for s, t in windows if s == b and t >= b + 11 and good[t]]
            last = max(ends, default=b + 11)
        else:
            ends = [t for s, t in windows if s == b and t >= max(e, min(b + 11, top)) and good[t]]
            last = min(ends, default=top)
        first = b if last - b + 1 >= 12 else max(0, last - 11)
        assert (first, last) in windows
        key = (last >= e, sum(w in stems for w in lex[first : last + 1]), good[last], -first, first, last)
        best = max(best or key, key)
    first, last = best[-2:] if best else (0, min(12, n) - 1)
    out = []
    for i in range(first, last + 1):
        a, b = spans[i]
        out.append(f"<b>{text[a:b]}</b>" if lex[i] in stems else text[a:b])
        if i < last:
            out.append(text[b : spans[i + 1][0]])
    return "".join(out)


def found(spark, texts, query, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r for r in fulltext.full_text(rows, "text", query, **options).collect()}


HAND = [
    ("foo & baz", "foo baz", "foo bar baz", 0.05),
    ("next to each other", "foo baz", "foo baz", 0.1),
    ("one word, three places", "foo", "foo x foo y foo", 0.3),
    ("covers share words", "foo baz", "foo baz foo", 0.2),
    ("a stop word between counts as a word", '"key of car"', "the key of a car, key to car", 0.1 / 2),
    ("a word of the query inside is no noise", "foo baz", "foo x foo baz", 0.1),
    ("either", "foo or baz", "baz x foo", 0.2),
    ("either phrase", '"foo baz" or qux', "foo baz qux", 0.2),
    ("three words", "a1 b1 c1", "a1 x b1 y z c1", 0.1 / 4),
    ("none of the unwanted", "foo -bar", "foo baz", 0.1),
    ("the other alternative is closed", "foo -bar or baz", "foo bar baz", 0.1),
    ("signs make a phrase", "foo-baz", "foo/baz and foo baz", 0.2),
    ("endings", "keys", "a key, the keys", 0.2),
    ("far apart", "foo baz", "foo " + "x " * 99 + "baz", 0.001),
]


@pytest.mark.parametrize("why, query, text, rank", HAND, ids=[h[0] for h in HAND])
def test_hand_worked_ranks(spark, why, query, text, rank):
    assert found(spark, [text], query)[0]["rank"] == pytest.approx(rank, abs=1e-6)


def test_forms_of_queries():
    p = lambda *stems: fulltext.Phrase(stems, tuple(range(len(stems))))
    c = lambda wanted, unwanted=(): fulltext.Conjunction(tuple(wanted), tuple(unwanted))
    assert fulltext.parse("remote keys") == (c([p("remote"), p("key")]),)
    assert fulltext.parse('"remote key" -broken OR -"old one" x') == (c([p("remote", "key")], [p("broken")]), c([p("x")], [p("old", "one")]))
    assert fulltext.parse('the or of "and" -the') == ()
    assert fulltext.parse('open "x y') == (c([p("open"), p("x", "y")]),)
    assert fulltext.parse("Clé") == (c([p("clé")]),) and fulltext.parse("Clé", True) == (c([p("cle")]),)
    assert fulltext.parse("") == () and fulltext.parse('- "" --') == ()


def test_folding_of_columns_equals_that_of_words(spark):
    words = ["Élan", "GRÖSSE", "straße", "Œuvre", unicodedata.normalize("NFD", "éclair"), "Łódź", "naïve", "日本", "ΣΑΣ", "İx"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fulltext.fold(fulltext.F.col("w")).alias("f")).collect()
    for r in rows[:-1]:
        assert r["f"] == fulltext.fold_word(r["w"]), r["w"]


def test_accents(spark):
    texts = ["la clé du véhicule", "la cle du vehicule"]
    assert set(found(spark, texts, "clé")) == set()  # the text is folded and the query is not
    assert set(found(spark, texts, "clé", fold_query=True)) == {0, 1} == set(found(spark, texts, "cle"))
    assert set(found(spark, texts, "clé", unaccent=False)) == {0}


QUERIES = ["ka lo", '"ka lo" or mi', "ka -lo", 'ka or lo -mi or "mi ka"', '"ka the lo" mi', "ka lo mi", "-ka", '-"ka lo" mi', "ka ka", "zu or -ka", "lo-mi"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_and_headlines_equal_brute_force(spark, query):
    r = random.Random(query)
    vocabulary = ["ka", "lo", "mi", "the", "x", "words", "of", "y", "longer", "Ka", "lós"]
    texts = [" ".join(r.choice(vocabulary[: r.randint(4, 11)]) for _ in range(r.choice([0, 3, 14, 60]))) for _ in range(60)]
    texts += [None, "", "ka, lo!", "ka " + "filler " * 50 + "lo", "mi.\n" * 20, "x y ka"]
    rows = found(spark, texts, query)
    for i, t in enumerate(texts):
        expected = brute(t, query)
        assert (i in rows) == (expected is not None), (t, query)
        if expected:
            assert rows[i]["rank"] == pytest.approx(expected[0], abs=1e-6), t
            assert rows[i]["headline"] == brute_headline(t or "", query, expected[1]), t


def test_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "ka lo", 5.0, "h")], "id int, text string, rank double, headline string")
    out = fulltext.full_text(rows, "text", "ka")
    assert out.columns == ["id", "text", "rank", "headline"] and out.first()["rank"] == pytest.approx(0.1)
    assert fulltext.full_text(rows.limit(0), "text", "ka").count() == 0 and fulltext.full_text(rows, "text", "the").count() == 0
    assert fulltext.full_text(rows, "text", "ka", headline=False).columns == ["id", "text", "headline", "rank"]


def test_best_pages(spark):
    texts = ["ka lo", "ka x lo", "kalo", "nothing here", "lo ka lo", None, "ka loo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [(r["id"], round(r["rank"], 6), r["headline"]) for r in fulltext.search_pages(rows, "text", "ka lo", ["id"], 5).collect()]
    assert got == [(4, 0.2, "<b>lo</b> <b>ka</b> <b>lo</b>"), (0, 0.1, "<b>ka</b> <b>lo</b>"), (1, 0.05, "<b>ka</b> x <b>lo</b>"), (2, 0.0, "kalo"), (6, 0.0, "<b>ka</b> loo")]
