"""Full-text search: web-style queries, cover-density rank, headlines.

A text is cut into words; each is lowered, its accents are folded, stop words are passed over
but keep their place, and the rest are stemmed.  A query is an alternative of conjunctions of
phrases, some of them negated.  A cover is a stretch of the text that satisfies the query and
holds no shorter one that does.  All of it is worked out within a row by built-in functions:
nothing is shuffled, and rows that lack a needed word are passed over before any word is cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import TRIGRAM_BOUND, trigram_similarity
from ..functions.text import col, worked_out

# The English stop words of text search.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Endings taken off, the first that fits: a plain form of English stemming.  What is left is a prefix of the word.
ENDINGS = ("ingly", "edly", "ing", "ed", "ies", "es", "s", "ly")
#: Letters that accent folding writes with others.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ł": "l", "ð": "d", "ı": "i", "ς": "σ"}
#: Fixed value: the weight of a word without a label.
WEIGHT = 0.1
#: Decimal places of a rank, so that equal sums in another order are equal ranks.
PLACES = 6
#: Words of a headline, and the length up to which a word does not end one.
MIN_WORDS, MAX_WORDS, SHORT_WORD = 12, 35, 3

WORD = r"[\p{L}\p{N}\p{M}]+"
TOKEN = WORD + r"[^\p{L}\p{N}\p{M}]*"
ACCENTED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and unicodedata.normalize("NFD", c)[0].isascii()}


def fold(word: Column) -> Column:
    """Lower case without accents."""
    out = F.translate(F.lower(word), "".join(ACCENTED), "".join(ACCENTED.values()))
    for c, s in SPELLED.items():
        out = F.replace(out, F.lit(c), F.lit(s))
    return F.regexp_replace(out, r"\p{M}+", "")


def fold_word(word: str) -> str:
    """The same for a word of a query."""
    low = "".join(SPELLED.get(c, ACCENTED.get(c, c)) for c in word.lower())
    return "".join(c for c in low if not unicodedata.category(c).startswith("M"))


def stem(word: Column) -> Column:
    out = word
    for e in reversed(ENDINGS):
        out = F.when(F.endswith(word, F.lit(e)) & (F.char_length(word) > len(e) + 2), F.substring(word, F.lit(1), F.char_length(word) - len(e))).otherwise(out)
    return out


def stem_word(word: str) -> str:
    """The same for a word of a query."""
    end = next((e for e in ENDINGS if word.endswith(e) and len(word) > len(e) + 2), "")
    return word[: len(word) - len(end)]


# -- queries --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Stems and how many words each stands after the first; stop words between them count."""

    stems: tuple[str, ...]
    steps: tuple[int, ...]


@dataclass(frozen=True)
class Conjunction:
    wanted: tuple[Phrase, ...]
    unwanted: tuple[Phrase, ...]


_PARTS = re.compile(r'(-?)"([^"]*)"?|(-?)([^\s"]+)')
_QUERY_WORDS = re.compile(r"[^\W_]+")


def phrase_of(words: str, folded: bool) -> Phrase | None:
    found = [(fold_word(w) if folded else w.lower(), i) for i, w in enumerate(_QUERY_WORDS.findall(unicodedata.normalize("NFC", words)))]
    found = [(stem_word(w), i) for w, i in found if w not in STOP_WORDS]
    if not found:
        return None
    return Phrase(tuple(w for w, _ in found), tuple(i - found[0][1] for _, i in found))


def parse(query: str, folded: bool = False) -> tuple[Conjunction, ...]:
    """The alternatives of a web-style query.

    Words must all occur; quotes make a phrase, as does a word with signs inside it; ``or``
    between two parts parts alternatives; a minus before a word or phrase excludes it.  Parts
    of stop words alone and alternatives of such parts alone are left out.  Accents are folded
    only if asked: by default they are not, so an accented word meets no folded text.
    """
    alternatives: list[tuple[list, list]] = [([], [])]
    for minus_phrase, phrase, minus, word in _PARTS.findall(query):
        if word.lower() == "or" and not minus:
            alternatives.append(([], []))
        elif (part := phrase_of(phrase or word, folded)) is not None:
            alternatives[-1][1 if minus_phrase or minus else 0].append(part)
    return tuple(Conjunction(tuple(dict.fromkeys(a)), tuple(dict.fromkeys(b))) for a, b in alternatives if a or b)


# -- one row --------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _least(values: Sequence[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _greatest(values: Sequence[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


#: Columns that live while a query is worked out.
TOKENS, LEXEMES, ENTRIES, GOOD, FOUND = "__ft_tokens", "__ft_lexemes", "__ft_entries", "__ft_good", "__ft_found"
PLACE = "struct<pos:int,idx:int>"
FRAGMENT = "struct<whole:int,words:int,good:int,early:int,first:int,last:int>"


class Search:
    """The expressions of one parsed query over the columns above."""

    def __init__(self, alternatives: Sequence[Conjunction]):
        self.alternatives = list(alternatives)
        self.phrases = list(dict.fromkeys(p for a in alternatives for p in (*a.wanted, *a.unwanted)))
        self.stems = sorted({s for p in self.phrases for s in p.stems})

    def known(self, lexeme: Column) -> Column:
        return lexeme.isin(self.stems) if self.stems else F.lit(False)

    def possible(self, text: Column, unaccent: bool) -> Column:
        """Whether the text holds the stems of some alternative as mere strings."""
        low = fold(text) if unaccent else F.lower(text)
        return _any([_all([F.contains(low, F.lit(s)) for p in a.wanted for s in p.stems]) for a in self.alternatives])

    def ends(self, phrase: Phrase, entry: Column) -> Column:
        """Whether an occurrence of the phrase ends at an entry."""
        last = phrase.steps[-1]
        return _all([entry["lexeme"] == phrase.stems[-1], *(F.coalesce(F.get(LEXEMES, entry["pos"] - (last - step)) == s, F.lit(False)) for s, step in zip(phrase.stems[:-1], phrase.steps[:-1], strict=True))])

    def start(self, phrase: Phrase, entry: Column) -> Column:
        """Place of the first word of the occurrence that ends at an entry."""
        if len(phrase.stems) == 1:
            return F.struct(entry["pos"].alias("pos"), entry["idx"].alias("idx"))
        pos = entry["pos"] - phrase.steps[-1]
        before = F.array_position(F.transform(ENTRIES, lambda x: x["pos"]), pos).cast("int") - 1
        return F.struct(pos.alias("pos"), before.alias("idx"))

    def occurs(self, phrase: Phrase) -> Column:
        return F.exists(ENTRIES, lambda x: self.ends(phrase, x))

    def allowed(self, a: Conjunction) -> Column:
        return _all([~self.occurs(p) for p in a.unwanted])

    def matches(self) -> Column:
        return _any([_all([self.occurs(p) for p in a.wanted]) & self.allowed(a) for a in self.alternatives])

    def begin(self, last: Column, entry: Column) -> Column:
        """The latest place from which the text up to ``entry`` satisfies the query, or null.

        ``last`` holds, for each phrase, the start of its last occurrence so far.
        """
        here = F.struct(entry["pos"].alias("pos"), entry["idx"].alias("idx"))
        each = []
        for k, a in enumerate(self.alternatives):
            places = [last[f"p{self.phrases.index(p)}"] for p in a.wanted]
            reach = F.when(_all([p.isNotNull() for p in places]), _least(places)) if places else here
            each.append(F.when(F.col(f"__ft_allowed{k}"), reach))
        return _greatest(each)

    def walk(self, with_fragment: bool) -> Column:
        """Sum of the covers' shares and the best fragment, in one pass over the entries."""
        names = [f"p{i}" for i in range(len(self.phrases))]
        nothing = [F.lit(None).cast(PLACE).alias(n) for n in names]
        zero = F.struct(F.lit(0.0).alias("rank"), F.lit(-1).alias("reached"), F.struct(*nothing).alias("last"), F.lit(None).cast(FRAGMENT).alias("best"))

        def step(state: Column, entry: Column) -> Column:
            last = F.struct(*[F.when(self.ends(p, entry), self.start(p, entry)).otherwise(state["last"][n]).alias(n) for p, n in zip(self.phrases, names, strict=True)])

            def judge(seen: Column) -> Column:
                new = seen["begin"].isNotNull() & (seen["begin"]["pos"] > state["reached"])
                noise = entry["pos"] - seen["begin"]["pos"] - (entry["idx"] - seen["begin"]["idx"])
                best = F.when(new, _greatest([state["best"], self.fragment(seen["begin"]["pos"], entry["pos"])])).otherwise(state["best"]) if with_fragment else state["best"]
                return F.struct(
                    (state["rank"] + F.when(new, WEIGHT / (1 + noise)).otherwise(0.0)).alias("rank"),
                    F.when(new, seen["begin"]["pos"]).otherwise(state["reached"]).alias("reached"),
                    seen["last"].alias("last"),
                    best.cast(FRAGMENT).alias("best"),
                )

            return _let(last, lambda seen: _let(F.struct(seen.alias("last"), self.begin(seen, entry).alias("begin")), judge))

        return F.aggregate(ENTRIES, zero, step) if self.phrases else zero

    def fragment(self, begin: Column, end: Column) -> Column:
        """The headline that a cover proposes: from its begin over MIN_WORDS to MAX_WORDS words.

        It ends at the first word after the cover that is long enough or of the query; a cover
        that is longer is cut at the last such word; at the end of the text it begins earlier.
        """
        top = F.size(LEXEMES) - 1
        reach = F.least(begin + (MAX_WORDS - 1), top)
        least = F.least(begin + (MIN_WORDS - 1), reach)
        good = lambda i: F.get(GOOD, i)
        later = F.coalesce(F.get(F.filter(F.sequence(F.least(F.greatest(end, least), reach), reach), good), 0), reach)
        sooner = F.coalesce(F.array_max(F.filter(F.sequence(least, reach), good)), least)
        last = F.when(end - begin + 1 >= MAX_WORDS, sooner).otherwise(later)

        def of(last: Column) -> Column:
            first = F.when(last - begin + 1 < MIN_WORDS, F.greatest(F.lit(0), last - (MIN_WORDS - 1))).otherwise(begin)
            words = F.size(F.filter(F.slice(LEXEMES, first + 1, last - first + 1), self.known))
            return F.struct((last >= end).cast("int").alias("whole"), words.alias("words"), good(last).cast("int").alias("good"), (-first).alias("early"), first.alias("first"), last.alias("last"))

        return _let(last, of)

    def headline(self, best: Column) -> Column:
        """The words of the best fragment as they stand in the text, those of the query in <b>."""
        first = F.coalesce(best["first"], F.lit(0))
        last = F.coalesce(best["last"], F.least(F.lit(MIN_WORDS), F.size(TOKENS)) - 1)

        def show(token: Column, i: Column) -> Column:
            word = F.regexp_extract(token, WORD, 0)
            shown = F.when(self.known(F.get(LEXEMES, first + i)), F.concat(F.lit("<b>"), word, F.lit("</b>"))).otherwise(word)
            return F.concat(shown, F.when(first + i < last, F.substring(token, F.char_length(word) + 1, F.char_length(token))).otherwise(""))

        return F.array_join(F.transform(F.slice(TOKENS, first + 1, F.greatest(last - first + 1, F.lit(0))), show), "")


def _cut(df: DataFrame, source: Column, search: Search, unaccent: bool) -> DataFrame:
    """``df`` with the words, lexemes and entries of its texts, and which alternatives are open to them."""
    folded = fold if unaccent else F.lower
    lexeme = lambda w: F.when(w.isin(*STOP_WORDS), F.lit("")).otherwise(stem(w))
    words = df.withColumn(TOKENS, F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0)))
    words = words.withColumn(LEXEMES, F.transform(TOKENS, lambda t: _let(folded(F.regexp_extract(t, WORD, 0)), lexeme)))
    entries = F.filter(F.transform(LEXEMES, lambda w, i: F.struct(i.alias("pos"), w.alias("lexeme"))), lambda x: search.known(x["lexeme"]))
    words = words.withColumn(ENTRIES, F.transform(entries, lambda x, i: F.struct(x["pos"].alias("pos"), x["lexeme"].alias("lexeme"), i.alias("idx"))))
    words = worked_out(words, {c: F.col(c) for c in (TOKENS, LEXEMES, ENTRIES)})
    return words.withColumns({f"__ft_allowed{k}": search.allowed(a) for k, a in enumerate(search.alternatives)})


def _with_headline(words: DataFrame, search: Search) -> DataFrame:
    """``words`` with rank and headline."""
    long_enough = lambda t, i: (F.char_length(F.regexp_extract(t, WORD, 0)) > SHORT_WORD) | search.known(F.get(LEXEMES, i))
    found = words.withColumn(GOOD, F.transform(TOKENS, long_enough)).withColumn(FOUND, search.walk(True))
    return found.withColumns({"rank": F.round(F.col(FOUND)["rank"], PLACES), "headline": search.headline(F.col(FOUND)["best"])})


def full_text(df: DataFrame, text: str, query: str, unaccent: bool = True, fold_query: bool = False, headline: bool = True) -> DataFrame:
    """Rows of ``df`` that satisfy ``query``, with rank and (unless switched off) headline.

    ``rank`` is the cover density of words without labels: each cover gives WEIGHT / (1 + the
    words in it that are not of the query), in six decimal places.  An alternative whose unwanted words occur in a text
    gives it no cover; one of unwanted words alone is satisfied at every word of the query.
    ``headline`` is the best fragment that a cover proposes: one that holds its whole cover
    first, then more words of the query, a better end, an earlier place; without a cover it is
    the first MIN_WORDS words.  Null and empty texts satisfy only alternatives of unwanted
    words; a query without any part finds nothing.  Positions and texts have no bound.
    """
    added = ["rank", "headline"] if headline else ["rank"]
    columns = [c for c in df.columns if c not in added]
    search = Search(parse(query, fold_query))
    source = F.coalesce(col(text).cast("string"), F.lit(""))
    words = _cut(df.filter(search.possible(source, unaccent)), source, search, unaccent).filter(search.matches())
    found = _with_headline(words, search) if headline else words.withColumn("rank", F.round(search.walk(False)["rank"], PLACES))
    return found.select(*columns, *added)


def search_pages(df: DataFrame, text: str, query: str, order: Sequence[str], limit: int = 10, unaccent: bool = True, fold_query: bool = False) -> DataFrame:
    """The ``limit`` best rows: those that satisfy the query, or are alike to it by trigrams.

    Rows that only their trigrams bring in have rank 0.  A top-k, so nothing is sorted whole, and
    headlines are made of its rows alone.  ``order`` names columns that part equal ranks.
    """
    search = Search(parse(query, fold_query))
    source = F.coalesce(col(text).cast("string"), F.lit(""))
    alike = F.coalesce(trigram_similarity(source, F.lit(query)) >= TRIGRAM_BOUND, F.lit(False))
    words = _cut(df.withColumn("__ft_alike", alike).filter(F.col("__ft_alike") | search.possible(source, unaccent)), source, search, unaccent)
    words = words.withColumn("__ft_matches", search.matches()).filter(F.col("__ft_alike") | F.col("__ft_matches"))
    words = words.withColumn("rank", F.when(F.col("__ft_matches"), F.round(search.walk(False)["rank"], PLACES)).otherwise(0.0))
    best = words.orderBy(F.desc("rank"), *order).limit(limit).withColumn("__ft_rank", F.col("rank"))
    shown = _with_headline(best, search).withColumn("rank", F.col("__ft_rank")).orderBy(F.desc("rank"), *order)
    return shown.select(*[c for c in df.columns if c not in ("rank", "headline")], "rank", "headline")
