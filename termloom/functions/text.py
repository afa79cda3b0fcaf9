"""Scalar text functions: tokens, escapes, dates, page fields, stemming, language profiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: The first stop words of English, used to pad short queries.
STOP_WORDS = ("the", "of", "and", "a", "in", "to", "it", "is", "was", "i", "for", "you", "he", "be", "with")


def tokens(text: Column, url: bool = False, repeat_hashtag: bool = False) -> Column:
    """Lower-cased tokens of ASCII letters, digits, # and @, in order.

    With url, links become the token URL; with repeat_hashtag, a tag is followed by its word. Null gives null.
    """
    raw = F.regexp_replace(text, r"https?://\S+", " URL ") if url else text
    found = F.filter(F.split(F.lower(raw), "[^a-z0-9#@]+"), lambda t: t != "")
    if url:
        found = F.transform(found, lambda t: F.when(t == "url", F.lit("URL")).otherwise(t))
    if repeat_hashtag:
        found = F.flatten(F.transform(found, lambda t: F.when(t.startswith("#") & (F.length(t) > 1), F.array(t, F.substring(t, 2, 1 << 20))).otherwise(F.array(t))))
    return found


def with_author(user: Column, text: Column) -> Column:
    return F.concat(F.lit("@"), user, F.lit(": "), text)


@F.pandas_udf(StringType())
def java_unescape(texts: pd.Series) -> pd.Series:
    r"""\t \n \r \b \f \\ \" \' and \uXXXX as the characters they stand for; pairs of surrogates are joined."""
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    one = lambda m: chr(int(m[1], 16)) if m[1] else plain.get(m[2], m[2])

    def undo(t: str) -> str:
        out = re.sub(r"\\(?:u+([0-9a-fA-F]{4})|(.))", one, t, flags=re.S)
        return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    return texts.map(undo, na_action="ignore")


@F.pandas_udf(StringType())
def java_escape(texts: pd.Series) -> pd.Series:
    names = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\\": "\\\\", '"': '\\"'}

    def one(m: re.Match) -> str:
        c = m[0]
        if c in names:
            return names[c]
        raw = c.encode("utf-16-be", "surrogatepass")
        return "".join(f"\\u{raw[i] << 8 | raw[i + 1]:04X}" for i in range(0, len(raw), 2))

    return texts.map(lambda t: re.sub(r'[^ !#-\[\]-~]', one, t), na_action="ignore")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def html_text(page: Column, start: str = "<article>", end: str = "</article>") -> Column:
    """Text between two markers of a page: tags removed, tabs and line ends as blanks, the common entities decoded."""
    inner = F.when(F.instr(page, start) > 0, F.substring_index(F.substring_index(page, start, -1), end, 1))
    shown = F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"[ \t\r\n]+", " ")
    for name, sign in _ENTITIES:
        shown = F.replace(shown, F.lit(name), F.lit(sign))
    return F.trim(shown)


def html_title(page: Column) -> Column:
    return F.nullif(F.regexp_extract(page, "<title>([^<]*)</title>", 1), F.lit(""))


def mail_time(text: Column) -> Column:
    """Epoch milliseconds of a date like `Sun Feb 06 10:38:43 +0000 2011`; null where it doesn't parse."""
    return F.unix_millis(F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))


def page_time(page: Column) -> Column:
    """Epoch milliseconds of a page's data="{time:'...'}" mark; null where it is missing or bad."""
    return mail_time(F.regexp_extract(page, r"""data="\{time:'([^']*)'\}""", 1))


# -- stemming: Porter's algorithm, run once for each distinct token ------------------------------------------------

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(w))))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


def stem(w: str) -> str:
    """Porter stem. Tags, mentions, the link placeholder and tokens that begin with a digit stay as they are."""
    if len(w) < 3 or w[0] in "#@U0123456789":
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        e = _longest(w, table)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = _longest(w, _STEP4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stemmed(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(stem, na_action="ignore")


def stem_table(vocabulary: DataFrame, col: str = "token") -> DataFrame:
    """(token, stem) of every distinct token: Python sees the vocabulary once, not the corpus."""
    return vocabulary.select(col).distinct().withColumn("stem", stemmed(col))


# -- language by n-gram profile ------------------------------------------------------------------------------------


def ngrams(text: Column, low: int = 1, high: int = 3) -> Column:
    """Character n-grams of the words of a text; `_` marks the edges of a word."""
    words = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    of = lambda w, n: F.transform(F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(w, i, n))
    return F.flatten(F.flatten(F.transform(words, lambda w: F.array(*[of(w, F.lit(n)) for n in range(low, high + 1)]))))


def profiles(samples: DataFrame, lang: str, text: str, size: int = 400) -> DataFrame:
    """(lang, ngram, place): the `size` most frequent n-grams of each language, most frequent first."""
    counts = samples.select(F.col(lang).alias("lang"), F.explode(ngrams(F.col(text))).alias("ngram")).groupBy("lang", "ngram").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "ngram"))
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "ngram", "place")


def identify(texts: DataFrame, known: DataFrame, id_col: str, text: str, size: int = 400) -> DataFrame:
    """(id, lang): the language whose profile is least out of place with the text's own; ties by name."""
    grams = texts.select(F.col(id_col).alias("id"), F.explode(ngrams(F.col(text))).alias("ngram")).groupBy("id", "ngram").count()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "ngram"))
    own = grams.withColumn("own", place).where(F.col("own") <= size).select("id", "ngram", "own")
    held = own.join(F.broadcast(known), "ngram")  # a profile has `size` rows
    gain = held.groupBy("id", "lang").agg(F.sum(F.lit(size) - F.abs(F.col("own") - F.col("place"))).alias("gain"))
    return gain.groupBy("id").agg(F.max_by("lang", F.struct("gain", F.col("lang"))).alias("lang")).withColumnRenamed("id", id_col)
