"""Quality rules, line first: lines are judged one by one, and a document goes if too much of it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import SPACE, WORD, lines, n_words, words

# Signs counted as symbols, and phrases of site furniture in the four languages of the corpus.
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript", "lorem ipsum",
    "subscribe to our newsletter", "click here", "sign up now", "log in to continue", "page not found",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "hier klicken", "seite nicht gefunden",
    "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici", "page introuvable",
    "política de privacidad", "términos de uso", "todos los derechos reservados", "haga clic aquí", "página no encontrada",
)
# A line fails the punctuation rule if this share of its word characters, or more, is noise.
NOISE = r"[#*$%&|<>{}\[\]=~^_\\]|[!?]{2,}"
SHOUT = r"[!?]{2,}"
MENU = r"(?<![^\x20\x09-\x0D])(?:[|»«›•·></–-]|::)(?![^\x20\x09-\x0D])"
SIGN = r"[#*$%&|<>{}\[\]=~^_\\!?»«›•·/:–-]"
BOILERPLATE_WORDS = 20
NOISE_SHARE = 0.1
MENU_SHARE = 0.2
SHOUT_SHARE = 0.3
LOST_SHARE = 0.5


def repeated_window_words(w: Column, width: int = 5) -> Column:
    """Words that stand in a window found twice or more.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated window sort them.
    """

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, e, j: F.get(s, j)["h"].eqNullSafe(e["h"])
        twice = let(by_hash, lambda s: F.filter(s, lambda e, j: same(s, e, j - 1) | same(s, e, j + 1)))
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        spans = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))))
        total = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)

    def windows(hw: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(hw) - width), lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(width)]))
        return F.when(F.size(hw) <= width, F.lit(0).cast("long")).otherwise(let(each, covered))

    return let(F.transform(w, lambda x: F.xxhash64(x)), windows)


def line_rules(line: Column) -> Column:
    """Which rule a line fails: punctuation, navigation or boilerplate; null if none. Blank lines pass.

    The counts behind the first two are taken only on lines that hold a sign they count.
    """
    n = F.regexp_count(line, F.lit(WORD))
    counts = F.struct(
        n.alias("n"),
        F.regexp_count(line, F.lit(MENU)).alias("entries"),
        F.regexp_count(line, F.lit(SHOUT)).alias("shouted"),
        (F.length(line) - F.length(F.regexp_replace(line, NOISE, ""))).alias("noise"),
        F.length(F.regexp_replace(line, SPACE + "+", "")).alias("chars"),
    )
    signs = let(
        counts,
        lambda c: F.when(c["n"] == 0, F.lit(None).cast("string"))
        .when(c["entries"] >= c["n"] * MENU_SHARE, F.lit("navigation"))
        .when((c["noise"] >= c["chars"] * NOISE_SHARE) | (c["shouted"] >= c["n"] * SHOUT_SHARE), F.lit("punctuation")),
    )

    def phrased(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | low.contains(p)
        return found & (n <= BOILERPLATE_WORDS)

    return F.coalesce(F.when(line.rlike(SIGN), signs), F.when(let(F.lower(line), phrased), F.lit("boilerplate")))


def judge_lines(docs: DataFrame) -> DataFrame:
    """docs plus base counts, the verdict, and `clean_text`: the text without failed lines.

    Null and empty texts have no word, fail the base rule and are not kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.withColumns(
        {
            "n_words": n_words(text),
            "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(
                F.filter(lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))
            ).cast("long"),
            "n_repeat_words": repeated_window_words(words(text)),
            "judged": F.transform(lines(text), lambda x: F.struct(x.alias("line"), line_rules(x).alias("rule"))),
        }
    )
    clean = F.array_join(F.transform(F.filter("judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    failed = F.filter("judged", lambda x: x["rule"].isNotNull())
    lost = F.aggregate(failed, F.lit(0).cast("long"), lambda acc, x: acc + n_words(x["line"]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({"lost_words": lost, "clean_text": clean, "base_failed": base}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * LOST_SHARE)
    ).drop("judged")
