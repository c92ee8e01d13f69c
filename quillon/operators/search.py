"""Relevance: BM25 over title and body, subsequence matching over key and title, rank fusion."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import STEMMERS
from ..plans import ir
from ..plans.ranking import ranked, tied
from . import similar

K1, B = 1.2, 0.75
#: Rank fusion adds 1 / (RRF + rank) for each ranking, ranks from 1.
RRF = 60

# The common English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def corpus_text(corpus) -> DataFrame:
    return corpus.documents.select("key", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("plain", F.lit(""))).alias("text"))


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; no stop words, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


# Words that the English stemmer treats by themselves.
_FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STEMS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings and what they become, longest first at equal places.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _ending(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Snowball stemmer for English, on lower-case words; words of other scripts stay."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _FORMS:
        return _FORMS[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    vowel = "aeiouy"

    def region(s: str, start: int) -> int:
        m = re.compile(f"[{vowel}][^{vowel}]").search(s, start)
        return m.end() if m else len(s)

    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else region(w, 0)
    r2 = region(w, r1)

    def short_end(s: str) -> bool:
        return bool(re.search(f"(?:[^{vowel}][{vowel}][^{vowel}wxY]|^[{vowel}][^{vowel}])$", s))

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{vowel}].", w[:-1]):
        w = w[:-1]
    if w in _STEMS:
        return w
    # past and progressive
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(f"[{vowel}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowel:
        w = w[:-1] + "i"
    # derivation
    end = _ending(w, _STEP2)
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        if end == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif end == "li":
            w = base if base[-1:] and base[-1] in "cdeghkmnrt" else w
        else:
            w = base + _STEP2[end]
    end = _ending(w, _STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _STEP3[end]
    end = _ending(w, _STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def analysis(analyzer: str, stop_words: tuple[str, ...] | None = None):
    """(stemmer, stop words) of an analyzer; only English brings stop words, for others they may be given."""
    if analyzer != "english" and analyzer not in STEMMERS:
        raise ValueError(f"no analyzer {analyzer!r}")
    given = stop_words if stop_words is not None else STOP_WORDS if analyzer == "english" else ()
    return stem if analyzer == "english" else STEMMERS[analyzer], frozenset(given)


def _stemmed(found: Column, analyzer: str, stop_words: tuple[str, ...] | None) -> Column:
    to_stem, stop = analysis(analyzer, stop_words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stemmed(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ws: [to_stem(w) for w in ws if w not in stop], na_action="ignore")

    return stemmed(found)


def tokens(text: Column, analyzer: str = "english", stop_words: tuple[str, ...] | None = None) -> Column:
    """``english``, ``german``, ``spanish`` and ``french`` drop stop words and stem; ``simple`` stays in the JVM."""
    found = simple_tokens(text)
    return found if analyzer == "simple" else _stemmed(found, analyzer, stop_words)


def query_tokens(query: str, analyzer: str = "english", stop_words: tuple[str, ...] | None = None) -> list[str]:
    found = re.findall(r"[^\W_]+", query.lower())
    if analyzer == "simple":
        return found
    to_stem, stop = analysis(analyzer, stop_words)
    return [to_stem(w) for w in found if w not in stop]


def language(corpus) -> str:
    """The analyzer of a corpus: its option ``language``, else English."""
    return corpus.options.get("language", "english")


def terms(corpus, analyzer: str | None = None) -> DataFrame:
    """(key, term, tf, dl): the index; dl is the document's number of tokens."""
    found = corpus_text(corpus).select("key", tokens(F.col("text"), analyzer or language(corpus), corpus.options.get("stop_words")).alias("tokens"))
    found = found.select("key", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return found.groupBy("key", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def corpus_size(corpus, index: DataFrame) -> DataFrame:
    """(n, avgdl): one row; documents without tokens count too."""
    lengths = index.select("key", "dl").distinct().agg(F.sum("dl").alias("total"))
    return corpus.documents.agg(F.count(F.lit(1)).alias("n")).crossJoin(lengths).select("n", (F.coalesce("total", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(corpus, query: str, analyzer: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(key, score) of documents with a positive score; each occurrence of a query token counts."""
    asked = query_tokens(query, analyzer or language(corpus), corpus.options.get("stop_words"))
    if not asked:
        return corpus.documents.select("key", F.lit(0.0).alias("score")).where("false")
    index = terms(corpus, analyzer) if index is None else index
    size = corpus_size(corpus, index)
    times = {t: asked.count(t) for t in asked}
    hits = index.where(F.col("term").isin(*times))
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    occurrences = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("term"))
    # as many rows of df as the query has tokens, and one row of sizes
    scored = hits.join(F.broadcast(counts), "term").crossJoin(F.broadcast(size))
    part = occurrences * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("key").agg(F.sum(part).alias("score")).where("score > 0")


# The scores of subsequence matching.
_MATCH, _GAP, _LONGER_GAP, _HEAD, _CAMEL, _SEPARATOR, _FIRST = 16, -3, -1, 8, 6, 7, 2


def subsequence_score(text: str, pattern: str) -> int | None:
    """The best alignment of the pattern as a subsequence of the text; None where there is none.

    Upper case in the pattern makes it case-sensitive. Matches at the head of a word score more, gaps
    cost a start and a little for each further character.
    """
    if not pattern:
        return 0
    if pattern == pattern.lower():
        text_c, pattern_c = text.lower(), pattern
        if len(text_c) != len(text):
            text = text_c
    else:
        text_c, pattern_c = text, pattern
    at = -1
    for c in pattern_c:
        at = text_c.find(c, at + 1)
        if at < 0:
            return None
    bonus = []
    for i, c in enumerate(text):
        before = text[i - 1] if i else ""
        bonus.append(_HEAD if not before or before in " \t" else _SEPARATOR if not before.isalnum() and c.isalnum() else _CAMEL if before.islower() and c.isupper() else 0)
    worst = -(10**9)
    ending = [worst] * len(text)  # the best score with the pattern so far ending here
    for j, c in enumerate(pattern_c):
        now, carried = [worst] * len(text), worst
        for i, t in enumerate(text_c):
            if t == c:
                value = _MATCH + bonus[i] * (_FIRST if j == 0 else 1)
                if j == 0:
                    now[i] = value
                else:
                    joined = ending[i - 1] if i else worst
                    best = max(joined, carried)
                    if best > worst // 2:
                        now[i] = best + value
            if j and i:
                # a gap opens behind i - 1 or a longer one goes on
                carried = max(carried + _LONGER_GAP, ending[i - 1] + _GAP)
        ending = now
    return max(ending)


def fuzzy(corpus, query: str) -> DataFrame:
    """(key, score): subsequence matches over key and title, positive scores only."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float("nan") if (s := subsequence_score(t, query)) is None else float(s))

    text = F.concat_ws(" ", F.col("key"), F.coalesce("title", "key"))
    # the cheap test first: a subsequence at all
    letters = [c for c in query]
    rough = F.lower(text).rlike("(?us)" + ".*".join(re.escape(c.lower()) for c in letters)) if letters else F.lit(True)
    found = corpus.documents.where(rough).select("key", score(text).alias("score"))
    return found.where(~F.isnan("score") & (F.col("score") > 0))


def fused(rankings: list[DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """(key, score): reciprocal rank fusion. Ranks are taken within the candidates; any ranking admits."""
    parts = []
    for ranking in rankings:
        rows = ranking if candidates is None else ranking.join(candidates.select("key"), "key", "left_semi")
        placed = ranked(rows.select("key", "score"), [F.desc("score"), F.asc("key")])
        parts.append(placed.select("key", (1.0 / (RRF + F.col("rank"))).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("key").agg(F.sum("part").alias("score"))


def scores(corpus, spec: ir.Search, candidates: DataFrame | None = None, analyzer: str | None = None) -> DataFrame:
    """(key, score) of a search clause; both queries given are fused. BM25 is fitted to the whole corpus."""
    rankings = []
    if spec.lexical is not None:
        rankings.append(bm25(corpus, spec.lexical, analyzer))
    if spec.fuzzy is not None:
        rankings.append(fuzzy(corpus, spec.fuzzy))
    if len(rankings) == 1:
        return rankings[0] if candidates is None else rankings[0].join(candidates.select("key"), "key", "left_semi")
    return fused(rankings, candidates)


def warnings(spec: ir.Search, analyzer: str = "english") -> list[str]:
    """Why a search finds nothing: a lexical query of stop words only."""
    return ["the lexical query has no searchable terms"] if spec.lexical is not None and not query_tokens(spec.lexical, analyzer) else []


def similar_classes(corpus, threshold: float = 0.85, least_tokens: int = 50, length_ratio: float = 2.0, analyzer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, score), a < b, of classes, and (key, class).

    Two classes are similar where the BM25 score of each against the other, over its score against itself,
    reaches the threshold; score is the lesser ratio. Documents with fewer than ``least_tokens`` tokens have
    no class, and lengths further apart than ``length_ratio`` don't pair.
    """
    found = corpus_text(corpus).select("key", tokens(F.col("text"), analyzer or language(corpus), corpus.options.get("stop_words")).alias("tokens"))
    return similar.classes(found, threshold, least_tokens, length_ratio, K1, B)


def similar_documents(corpus, **options) -> DataFrame:
    """(key, class, class_size, links): one row a document; links counts its copies and all documents of similar classes."""
    pairs, members = similar_classes(corpus, **options)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    more = both.join(sizes.select(F.col("class").alias("other"), F.col("size").alias("n")), "other").groupBy("class").agg(F.sum("n").alias("more"))
    links = (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links")
    return members.join(sizes, "class").join(more, "class", "left").select("key", "class", F.col("size").alias("class_size"), links)


def most_similar(corpus, keys: DataFrame, k: int = 3, **options) -> DataFrame:
    """(key, other, score, rank): the best partners of the given documents, copies first."""
    pairs, members = similar_classes(corpus, **options)
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("near"), "score").unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("near"), "score"))
    asked = members.join(keys.select("key"), "key", "left_semi")
    own = asked.select("key", F.col("class").alias("near"), F.lit(1.0).alias("score"))
    near = own.unionByName(asked.join(both, "class").select("key", "near", "score"))
    # of each near class only its first k + 1 documents can be among the best
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("key"))).where(F.col("n") <= k + 1)
    found = near.join(first.select(F.col("class").alias("near"), F.col("key").alias("other")), "near").where("key <> other")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "other", "score", "rank")


def sections(corpus, query: str, limit: int = 100, analyzer: str | None = None) -> DataFrame:
    """(key, pos, text, score): sections by fuzzy text and their document's BM25, ranks shared on ties.

    Sections that neither ranking finds stay, last.
    """
    kept = re.sub(r"[^\w\s/]|_", "", query)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0.0 if (s := subsequence_score(t, kept)) is None else float(s))

    headers = corpus.blocks.where("kind = 'header'").select("key", "pos", F.concat_ws(" / ", F.concat("path", F.array("plain_text"))).alias("text"))
    rows = headers.withColumn("fuzzy", score("text")).join(bm25(corpus, query, analyzer).select("key", F.col("score").alias("lexical")), "key", "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    for c in ("fuzzy", "lexical"):
        rows = tied(rows, c, f"{c}_rank")
    part = lambda c: F.when(F.col(c) > 0, 1.0 / (RRF + F.col(f"{c}_rank"))).otherwise(0.0)
    return rows.select("key", "pos", "text", (part("fuzzy") + part("lexical")).alias("score")).orderBy(F.desc("score"), "key", "pos").limit(limit)
