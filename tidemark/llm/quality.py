"""Quality rules from distribution divergence, in DataFrame functions only.

A document's histogram of character classes and of its language's common words is compared with the reference of that
language by the Jensen-Shannon distance. References are sums over all documents of the language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, checkpoint, column, small

#: Character classes, in the order of the histogram; ``other`` is what none of them holds.
CLASSES = ("letter", "digit", "space", "punctuation", "symbol", "other")
BLANK, SYMBOLS, MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>", ".,;:!?'\"()-"
#: Length of the word windows whose repeats count.
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more.

    Windows are compared by a 64-bit hash; its lowest bits then give way to the window's position, so that one sort of
    plain numbers puts equal windows together.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

    def covered(h: Column) -> Column:
        places = F.call_function("shiftleft", F.lit(1).cast("long"), bits)

        def spread(s: Column) -> Column:
            key = lambda x: F.call_function("shiftright", x, bits)
            twice = F.filter(s, lambda x, j: (key(x) == key(F.get(s, j - 1))) | (key(x) == key(F.get(s, j + 1))))
            at = F.sort_array(F.transform(twice, lambda x: F.pmod(x, places)))
            start = F.struct(F.lit(-size).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size).cast("long"), p - a["last"])).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        packed = F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits) + i)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(packed), spread))

    return F.when(n < size, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def common_words(docs: DataFrame, top: int = 12, longest: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, common``: the ``top`` most frequent words of at most ``longest`` letters in all documents of each language."""
    short = F.filter(F.regexp_extract_all(column(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) <= longest)
    counts = docs.select(column(lang).alias("lang"), F.explode(short).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("w").rlike(r"^\p{L}+$")).groupBy("lang", F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    kept = counts.withColumn("r", first).filter(F.col("r") <= top)
    return kept.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("common"))


def _beside(docs: DataFrame, per_lang: DataFrame, most: int = 10_000) -> DataFrame:
    """Left join on the language, null matching null; a few thousand languages are broadcast."""
    side = per_lang.withColumnRenamed("lang", "_lang")
    return docs.join(F.broadcast(side) if small(side, most) else side, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


def base_metrics(docs: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, and the two histograms.

    ``classes`` counts the characters of each of ``CLASSES``, ``hits`` the document's uses of each common word of its
    language, in the order of ``common``, and last its other words. Null texts count as empty.
    """
    d = docs.select(column(doc_id).alias("doc_id"), column(lang).alias("lang"), F.coalesce(column(text), F.lit("")).alias("text"))
    d = _beside(d, common)
    t = F.col("text")

    def by_words(w: Column) -> Column:
        short = F.filter(w, lambda x: F.length(x) <= F.coalesce(F.array_max(F.transform("common", F.length)), F.lit(0)))
        line = F.concat(F.lit(" "), F.lower(F.array_join(short, "  ")), F.lit(" "))
        uses = lambda s: F.transform("common", lambda q: ((F.length(s) - F.length(F.replace(s, F.concat(F.lit(" "), q, F.lit(" ")), F.lit("")))) / (F.length(q) + 2)).cast("long"))
        hits = F.coalesce(let(line, uses), F.array().cast("array<bigint>"))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), hits.alias("hits"))

    def by_rest(r: Column) -> Column:
        """``r``: the text without letters."""
        n = F.length(r)
        space, marks, symbols = (n - F.length(_without(r, x)) for x in (BLANK, MARKS, SYMBOLS))
        digits = n - F.length(F.regexp_replace(r, r"\p{Nd}+", ""))
        letters = F.length(t) - n
        classes = F.array(letters, digits, space, marks, symbols, n - digits - space - marks - symbols)
        return F.struct((F.length(t) - space).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), classes.cast("array<bigint>").alias("classes"))

    def by_lines(x: Column) -> Column:
        return (F.size(x) - F.size(F.array_distinct(x))).cast("long")

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    d = d.select("doc_id", "lang", F.inline(F.transform(F.array(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))), by_words)), "text")
    d = d.select("doc_id", "lang", "n_words", "n_repeat_words", "hits", let(lines, by_lines).alias("n_dup_lines"), F.inline(F.transform(F.array(F.regexp_replace(t, r"\p{L}+", "")), by_rest)))
    other = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", F.concat("hits", F.array(other)).alias("hits"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms of equal length; NULL where one is empty or missing."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    share = lambda x: F.transform(x, lambda v: v / F.nullif(total(x), F.lit(0.0)))
    term = lambda v: F.when(v > 0, v * F.log2(v)).otherwise(0.0)
    each = F.zip_with(share(a), share(b), lambda p, q: (term(p) + term(q)) / 2 - term((p + q) / 2))
    return F.sqrt(F.greatest(total(each), F.lit(0.0)))


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", class_limit: float = 0.25, word_limit: float = 0.5, min_chars: int = 200, min_words: int = 100, min_reference_words: int = 2_000
) -> DataFrame:
    """Base counts and verdict of every document.

    Adds to ``base_metrics`` the distances ``class_distance`` and ``word_distance``, ``base_failed`` (fewer than 20
    words, or over 30 % of them in repeated windows of eight) and ``kept``: not failed, and no distance over its limit.
    A distance counts only for documents of at least ``min_chars`` characters or ``min_words`` words, and languages
    with ``min_reference_words`` words. Null languages are a language of their own; null and empty texts fail; repeated
    rows are judged each; no documents, no rows.
    """
    rows = checkpoint(base_metrics(docs, checkpoint(common_words(docs, text=text, lang=lang)), doc_id, text, lang))
    position = rows.select("lang", F.col("n_words"), F.posexplode(F.concat("classes", "hits")).alias("p", "n"))
    sums = position.groupBy("lang", "p").agg(F.sum("n").cast("double").alias("n"))
    ref = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "n"))), lambda x: x["n"]).alias("ref"))
    k = len(CLASSES)
    ref = ref.select("lang", F.slice("ref", 1, k).alias("ref_classes"), F.slice("ref", F.lit(k + 1), F.size("ref")).alias("ref_hits"))
    d = _beside(rows, checkpoint(ref))
    enough = F.aggregate("ref_hits", F.lit(0.0), lambda a, x: a + x) >= min_reference_words
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumns({"class_distance": js_distance(F.col("classes").cast("array<double>"), F.col("ref_classes")), "word_distance": js_distance(F.col("hits").cast("array<double>"), F.col("ref_hits"))})
    far = enough & (((chars >= min_chars) & (F.col("class_distance") > class_limit)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "classes", "hits")
