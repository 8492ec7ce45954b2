"""Text expressions: the tokenizer shared by index and query, and small string utilities.

Everything but NFKC is built from Spark expressions. Texts without a CJK character skip the steps that
only such texts need.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The CJK character class and the separator class of the tokenizer.
CJK = "⺀-⻿⼀-⿟぀-ゟ゠-ヺー-ヿ㄀-ㄯ㈀-㋿㐀-䶿一-鿿豈-﫿"
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC; texts that are already in that form are not copied."""
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def _ranges(points: list[int]) -> str:
    """Character class of the code points, which are in order."""
    starts = [p for p in points if p - 1 not in set(points)]
    ends = [p for p in points if p + 1 not in set(points)]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


#: Characters that NFKC neither changes nor joins with others: those below U+0180 that are their own form,
#: and CJK ideographs, kana and CJK punctuation. Text of these alone, the usual case, needs no normalisation.
STABLE = _ranges([c for c in range(0x180) if unicodedata.is_normalized("NFKC", chr(c))]) + "一-鿿ぁ-ゖァ-ヺー、。「」"


def normalised(text: Column) -> Column:
    """NFKC; only texts with a character that may change go through Python."""
    may_change = text.rlike(r"[^\x00-\x7F]") & text.rlike(f"[^{STABLE}]")
    return F.when(may_change, nfkc(F.when(may_change, text))).otherwise(text)


#: Session setting with the path of a folding table that is used instead of ICU's rules, as it is: UTF-8
#: lines of a character, a tab and its simplified form. An index must be searched with the table it was built with.
FOLDS = "spark.quillspark.folds"


@cache
def _folding(_session: str, path: str | None) -> tuple[str, str]:
    spark = SparkSession.getActiveSession()
    if path:
        lines = [r["value"].split("\t") for r in spark.read.text(path).collect()]  # no more than there are characters
        if wrong := [x for x in lines if list(map(len, x)) != [1, 1]]:
            raise ValueError(f"{path}: a line must be two characters with a tab between, not {wrong[0]}")
        table = dict(lines)
        if len(table) < len(lines):
            raise ValueError(f"{path}: a character is given twice")
        return "".join(table), "".join(table.values())
    rule = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    bounds = [(CJK[i], CJK[i + 2]) for i in range(0, len(CJK), 3)]  # low, hyphen, high
    chars = [chr(c) for lo, hi in bounds for c in range(ord(lo), ord(hi) + 1)]
    step = lambda xs: rule.transliterate("\n".join(xs)).split("\n")
    table = {a: b for a, b in zip(chars, step(chars), strict=True) if a != b and len(b) == 1}
    for a, b in table.items():  # one application must be as good as two
        seen = {a}
        while b in table and b not in seen:
            seen.add(b)
            b = table[b]
        table[a] = b
    table = {a: b for a, b in table.items() if a != b}
    return "".join(table), "".join(table.values())


def folding() -> tuple[str, str]:
    """Traditional characters and, at the same places, their simplified forms, by ICU's rules or the table of ``FOLDS``."""
    spark = SparkSession.getActiveSession()
    return _folding(spark.sparkContext.applicationId, spark.conf.get(FOLDS, None))


def fold(text: Column) -> Column:
    """Traditional to simplified, character by character."""
    traditional, simplified = folding()
    return F.translate(text, traditional, simplified)


def is_cjk(word: Column) -> Column:
    return word.rlike(f"^[{CJK}]+$")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def spaced(text: Column) -> Column:
    """A space at each border between CJK and other characters."""
    return F.regexp_replace(text, f"(?<=[{CJK}])(?=[^{CJK}])|(?<=[^{CJK}])(?=[{CJK}])", " ")


def _segments(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def grams(word: Column) -> Column:
    """All characters of a word, then all its neighbouring pairs."""
    n = F.length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(word, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2)))
    return F.when(n == 1, single).otherwise(F.concat(single, pairs))


def tokens(text: Column, normalized: bool = False) -> Column:
    """Tokens in order, repeats and case kept; an empty array for null.

    ``normalized`` says that the text already is in NFKC, and spares the step.
    """
    text = F.coalesce(text if normalized else normalised(text), F.lit(""))
    mixed = F.flatten(F.transform(_segments(spaced(fold(text))), lambda s: F.when(is_cjk(s), grams(s)).otherwise(F.array(s))))
    return F.when(has_cjk(text), mixed).otherwise(_segments(text))


def terms(raw: Column) -> Column:
    """Index terms of raw tokens."""
    return F.transform(raw, lambda t: F.lower(t))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which the edit budget is counted."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


# --- names, keys and links ---


def store_key(instance_url: Column, account_id: Column) -> Column:
    return F.concat(F.lit("store:"), instance_url, F.lit(":"), account_id)


def index_key(instance_url: Column, account_id: Column) -> Column:
    return F.concat(F.lit("index:"), instance_url, F.lit(":"), account_id)


def instance_url(typed: Column) -> Column:
    """Origin of whatever names an instance: a handle, a host or an address."""
    host = F.regexp_replace(F.trim(typed), "^@", "")
    host = F.regexp_replace(F.regexp_replace(host, "^https?://", ""), r"/.*$", "")
    return F.concat(F.lit("https://"), F.substring_index(host, "@", -1))


def account_name(acct: Column) -> Column:
    return F.split(acct, "@")[0]


def account_host(acct: Column) -> Column:
    """What follows the first ``@``, up to a second; null if there is none."""
    return F.get(F.split(acct, "@"), F.lit(1))


def qualified(acct: Column, username: Column, host: Column) -> Column:
    return F.when(F.contains(acct, F.lit("@")), acct).otherwise(F.concat(username, F.lit("@"), host))


def is_handle(typed: Column) -> Column:
    return typed.rlike(r"^[^@\s]+@[^@\s]+$")


def status_link(url: Column, instance: Column, acct: Column, status_id: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(instance, F.lit("/@"), acct, F.lit("/"), status_id))


def profile_link(url: Column, instance: Column, acct: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(instance, F.lit("/@"), acct))


def media_link(url: Column, link: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), link)


def display_name(name: Column, acct: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), acct)


def initial(name: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.substr(name, F.lit(1), F.lit(1))), F.lit("")), F.lit("?"))


# Labels of the types.
BADGES = {"post": "原創", "boost": "轉嘟", "favourite": "喜歡", "bookmark": "書籤"}


def badges(types: Column) -> Column:
    """Labels in the order of the types; unknown types have none."""
    labels = F.create_map(*[F.lit(x) for pair in BADGES.items() for x in pair])
    return F.filter(F.transform(types, lambda t: labels[t]), lambda b: b.isNotNull())


def count_label(n: Column) -> Column:
    return F.format_number(n, 0)
