"""Line-first cleaning: rules drop lines, then documents that lost too much text are rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from candela.llm.common import free_names, let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

NAVIGATION = ("home", "menu", "next", "previous", "back", "back to top", "login", "log in", "sign in", "sign up", "register",
              "subscribe", "share", "share this", "read more", "more", "search", "skip to content", "skip to main content",
              "contact us", "about us", "sitemap", "print", "reply", "comments", "next page", "previous page")
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies",
               "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "licensed under the",
               "subscribe to our newsletter", "click here to")


@dataclass(frozen=True)
class LineRules:
    """Thresholds; all are compared per line that holds a word."""

    max_symbols_per_word: float = 0.3      # symbols and separators against words: menus, markup, decorated words
    max_shouts_per_word: float = 0.3       # exclamation and question marks against words
    unpunctuated_words: int = 12           # a line this long without any sentence mark is no prose
    max_stutter_share: float = 0.3         # words equal to the word before them
    boilerplate_words: int = 30            # boilerplate phrases count only in lines up to this long
    max_lost_share: float = 0.4            # of the characters in words


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def stutters(word: Column) -> Column:
    return F.size(F.filter(word, lambda x, i: x == F.get(word, i - 1)))


def line_fails(line: Column, rules: LineRules) -> Column:
    return let(words(line), lambda word: words_fail(line, word, rules))


def words_fail(line: Column, word: Column, rules: LineRules) -> Column:
    n = F.size(word)
    plain = F.lower(F.btrim(line))
    return ((count_of(line, r"[#*$%&|<>{}~^=\\»›•·]") > rules.max_symbols_per_word * n)
            | (count_of(line, r"[!?]") > rules.max_shouts_per_word * n + 2)
            | ((n >= rules.unpunctuated_words) & ~line.rlike(r"[.!?;:,…。]"))
            | (~line.rlike("[a-z]") & line.rlike("(?:[A-Z][^A-Z]*){20}"))
            | (stutters(word) > rules.max_stutter_share * n)
            | plain.isin(*NAVIGATION)
            | ((n <= rules.boilerplate_words) & plain.rlike("|".join(BOILERPLATE))))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def repeated_words(word: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, by sorting window hashes: m log m for m words."""
    def covered(keys: Column) -> Column:
        def starts(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            twin = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (F.get(pairs, j - 1)["h"] == F.get(pairs, j)["h"]))
                            | ((j < last) & (F.get(pairs, j + 1)["h"] == F.get(pairs, j)["h"])))
            return F.sort_array(F.transform(twin, lambda j: F.get(pairs, j)["p"]))
        pairs = F.sort_array(F.transform(keys, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.aggregate(let(pairs, starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda s, p: F.struct((s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - p)).alias("n"), (p + WINDOW).alias("end")),
                           lambda s: s["n"])

    keys = F.transform(F.sequence(F.lit(0), F.size(word) - WINDOW),
                       lambda i: F.xxhash64(*[F.get(word, i + j) for j in range(WINDOW)]))
    return F.when(F.size(word) > WINDOW, let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(0))).otherwise(0)


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), name: str = "quality") -> DataFrame:
    """The rows with one struct column ``quality``; a column of that name is replaced. A map, no shuffle.

    Fields: ``text`` (kept lines), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lines_removed``, ``lost_chars`` (word characters in removed lines), ``base_failed`` and ``kept``. Lines
    without a word are never removed. Null or empty text: no words, base_failed, not kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")

    def of_lines(lines: Column) -> Column:
        return let(F.filter(lines, has_word), lambda full: F.struct(
            (F.size(full) - F.size(F.array_distinct(full))).alias("n_dup_lines"), F.size(full).alias("n_full"),
            F.filter(lines, lambda x: ~(has_word(x) & line_fails(x, rules))).alias("kept")))

    def of_words(word: Column) -> Column:
        return F.struct(F.size(word).alias("n_words"), F.length(F.array_join(word, "")).alias("chars"), repeated_words(word).alias("n_repeat"))

    lines, word = let(F.split(t, "\n"), of_lines), let(words(t), of_words)

    def verdict(both: Column) -> Column:
        a, b = both["a"], both["b"]
        def judged(clean: Column) -> Column:
            left = word_chars(clean)
            base = (b["n_words"] < 20) | (100 * b["n_repeat"] > 30 * b["n_words"])
            return F.struct(clean.alias("text"), b["n_words"].cast("long").alias("n_words"), b["chars"].cast("long").alias("word_chars"),
                            count_of(t, SYMBOLS).cast("long").alias("n_symbols"), a["n_dup_lines"].cast("long").alias("n_dup_lines"),
                            b["n_repeat"].cast("long").alias("n_repeat_words"),
                            (a["n_full"] - F.size(F.filter(a["kept"], has_word))).cast("long").alias("n_lines_removed"),
                            (b["chars"] - left).cast("long").alias("lost_chars"), base.alias("base_failed"),
                            (~base & (b["chars"] - left <= rules.max_lost_share * b["chars"])).alias("kept"))
        return let(F.array_join(a["kept"], "\n"), judged)

    return docs.withColumn(name, let(F.struct(lines.alias("a"), word.alias("b")), verdict))


def kept_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their cleaned text and its length in code points.

    The verdict leaves through a generated row: a filter on the struct itself would be pushed below it and work out all
    rules once more for every field that is read.
    """
    verdict, clean, n = free_names(docs, 3)

    def row(q: Column) -> Column:
        one = F.array(F.struct(q["text"].alias(clean), F.length(q["text"]).cast("long").alias(n)))
        return F.when(q["kept"], one).otherwise(F.slice(one, 1, 0))
    judged = clean_lines(docs, text, rules, verdict).select(*docs.columns, F.inline_outer(let(F.col(verdict), row)))
    return judged.filter(F.col(n).isNotNull()).select(*[F.col(clean if c == text else n if c == n_chars else c).alias(c) for c in docs.columns])
