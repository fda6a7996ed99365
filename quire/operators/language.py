"""Language of a text: script majority, else a vote of function words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.words import LEAD, MIN_LETTERS, MIN_SHARE, MIN_TOKENS, SAMPLE_CHARS, STOPWORDS

SCRIPTS = {"latin": "\\p{IsLatin}", "cyrillic": "\\p{IsCyrillic}", "greek": "\\p{IsGreek}", "arabic": "\\p{IsArabic}", "hebrew": "\\p{IsHebrew}", "han": "\\p{IsHan}", "kana": "\\p{IsHiragana}\\p{IsKatakana}", "hangul": "\\p{IsHangul}", "devanagari": "\\p{IsDevanagari}", "thai": "\\p{IsThai}"}


def script_counts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, others, letters, and the letters of each script in the whole text.

    Letters that no text of Latin alone has are looked for first, so that most texts need one pass more, not ten.
    """
    s = F.col("text")
    beyond = s.rlike("[\\p{L}&&[^\\p{IsLatin}]]")

    def count(name, pattern):
        n = F.regexp_count(s, F.lit(f"[{pattern}&&\\p{{L}}]"))
        return n if name == "latin" else F.when(beyond, n).when(s.isNotNull(), 0)

    return docs.select("doc_id", *others, F.regexp_count(s, F.lit("\\p{L}")).cast("long").alias("letters"), *[count(n, p).cast("long").alias(n) for n, p in SCRIPTS.items()])


def guess(docs: DataFrame) -> DataFrame:
    """doc_id, guessed: a language or an empty string where it is too close to call.  Only a sample is looked at, the
    first SAMPLE_CHARS characters.

    A projection of the document's row: tokens are looked up in the languages' sets of function words, no exchange.
    """
    sample = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    tokens = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda t: t != "")
    rows = script_counts(sample, "text").withColumn("tokens", tokens)
    listed = sorted({w for ws in STOPWORDS.values() for w in ws.split()})
    rows = rows.withColumn("total", F.size("tokens")).withColumn("hits", F.filter("tokens", lambda t: t.isin(listed)))
    held = lambda lang: F.size(F.filter("hits", lambda t: t.isin(STOPWORDS[lang].split())))
    rows = rows.withColumn("v", F.sort_array(F.array(*(F.struct(held(lang).alias("n"), F.lit(lang).alias("guess")) for lang in STOPWORDS)), False))
    best, second = F.col("v")[0]["n"], F.col("v")[1]["n"]
    latin = (
        F.when(F.coalesce("total", F.lit(0)) < MIN_TOKENS, "")
        .when((best == 0) | (best < MIN_SHARE * F.col("total")), "")
        .when((second > 0) & (best < LEAD * second), "")
        .otherwise(F.col("v")[0]["guess"])
    )
    other = (
        F.when(F.col("kana") > 0, "ja")
        .when(F.col("hangul") >= F.greatest("cyrillic", "han", "arabic"), "ko")
        .when(F.col("han") > 0, "zh")
        .when(F.col("cyrillic") >= F.greatest("greek", "arabic", "hebrew"), "ru")
        .when(F.col("arabic") > 0, "ar").when(F.col("hebrew") > 0, "he").when(F.col("greek") > 0, "el").when(F.col("devanagari") > 0, "hi").when(F.col("thai") > 0, "th")
        .otherwise("")
    )
    return rows.select("doc_id", F.when(F.coalesce("letters", F.lit(0)) < MIN_LETTERS, "").when(F.col("letters") - F.col("latin") > F.col("latin"), other).otherwise(latin).alias("guessed"))
