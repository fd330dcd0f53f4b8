"""Quality rules by distribution divergence, in DataFrame functions only.

Rules on words, repeated lines and repeated word windows come first.  A document
that passes them is compared with the reference of its language: the histogram of
its character classes and that of its common words, with one bin for all other
words, against the mean histograms of the documents of that language that pass.
The Jensen-Shannon distance of either must stay under a limit.  That of the words
is taken without the part that chance alone gives a text of so many words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import let, written

# Common words of the languages whose word histogram is compared.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on".split(),
    "de": "der die und in den von zu das mit ist ein auf".split(),
    "fr": "de la le et les des en un une que est qui".split(),
    "es": "de la que el en y a los se del las un".split(),
}
CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "other")
LEAST_WORDS = 50  # fewer words: rejected by rule
CLASS_LIMIT = 0.35  # Jensen-Shannon distance, 0 to 1
WORD_LIMIT = 0.16  # least mean of both error rates on the labelled rows of sf0.1 with crc32(doc_id) % 5 <> 0
SPACES = r"[ \t-\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return let(lines, lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long"))


def window_hashes(list_of: Column) -> Column:
    """Hashes of all windows of three words, in order; ``list_of`` is a lambda variable."""
    n = F.size(list_of)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.element_at(list_of, i), F.element_at(list_of, i + 1), F.element_at(list_of, i + 2)))


def by_hash(hashes: Column) -> Column:
    """Windows as (hash, place) sorted by hash, so that equal ones are neighbours; empty if all differ."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_words(placed: Column) -> Column:
    """Words in windows that occur twice or more, each word once.

    A window is repeated if a neighbour in hash order has its hash; the places of
    those are sorted again and their stretches of three words joined.
    """
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(placed.alias("own"), F.concat(nothing, placed).alias("left"), F.slice(placed, F.lit(2), F.size(placed)).alias("right"))
    again = F.filter(beside, lambda x: x["own"].isNotNull() & (F.coalesce(x["own"]["h"] == x["left"]["h"], F.lit(False))
                                                               | F.coalesce(x["own"]["h"] == x["right"]["h"], F.lit(False))))
    places = F.sort_array(F.transform(again, lambda x: x["own"]["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(3))).alias("sum")),
                          lambda acc: acc["sum"])
    return covered.cast("long")


def described(text: Column, language: Column) -> Column:
    """Struct of the counts of a text; ``_classes`` and ``_common`` are histograms as arrays.

    The last bin of ``_common`` counts all words but the common ones; a language
    without common words has no such histogram.
    """
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    every = sorted({w for v in COMMON_WORDS.values() for w in v})

    def kept(own: Column, keep: str) -> Column:
        return F.length(F.regexp_replace(own, f"[^{keep}]+", "")).cast("long")

    def counts(own: Column, ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w: F.when(F.length(w) <= 5, F.lower(w))), lambda w: w.isin(every))
        common = let(hits, lambda found: F.transform(F.try_element_at(lists, language), lambda w: F.size(F.filter(found, lambda h: h == w)).cast("double")))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            kept(own, r"#*$%&|<>").alias("n_symbols"), duplicate_lines(own).alias("n_dup_lines"),
            let(window_hashes(ws), lambda hs: let(by_hash(hs), repeated_words)).alias("n_repeat_words"),
            kept(own, r"\p{Lu}").alias("upper"), kept(own, r"\p{L}").alias("letters"), kept(own, "0-9").alias("digits"),
            kept(own, r".,;:!?'\"()\-").alias("marks"), common.alias("_common"))

    def completed(c: Column) -> Column:
        parts = [c["letters"] - c["upper"], c["upper"], c["digits"], c["marks"], c["n_symbols"],
                 c["word_chars"] - c["letters"] - c["digits"] - c["marks"] - c["n_symbols"]]
        common = F.concat(c["_common"], F.array(c["n_words"] - total(c["_common"])))
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        return F.struct(*[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        F.array(*[F.greatest(p, F.lit(0)).cast("double") for p in parts]).alias("_classes"), common.alias("_common"),
                        failed.alias("base_failed"))

    return let(let(F.coalesce(text, F.lit("")), lambda own: let(words(own), lambda ws: counts(own, ws))), completed)


def _language(docs: DataFrame, lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``_key, _lang`` and the fields of ``described`` of every row."""
    counted = docs.select(F.col(key).alias("_key"), F.col(text).alias("_body"), _language(docs, lang).alias("_lang"))
    return counted.select("_key", "_lang", described(F.col("_body"), F.col("_lang")).alias("_c")).select("_key", "_lang", "_c.*")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def shares(values: Column) -> Column:
    return F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(total(values), F.size(values)).alias("t")), lambda x: x["v"] / x["t"])


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of shares: the root of the divergence to base 2, from 0 (equal) to 1 (disjoint)."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def references(found: DataFrame) -> DataFrame:
    """``_lang, _class_ref, _word_ref``: mean histograms of the documents of a language that pass the rules.

    Failed documents count as NULL instead of being filtered out: a filter would be pushed into
    the counts and compute them again.
    """
    good = ~F.col("base_failed")
    classes = F.when(good & (total(F.col("_classes")) > 0), shares(F.col("_classes")))
    common = F.when(good, shares(F.col("_common")))
    at_most = max(len(CLASSES), *(len(v) + 1 for v in COMMON_WORDS.values()))
    apart = found.select("_lang", classes.alias("_p"), common.alias("_q"))
    means = apart.groupBy("_lang").agg(*[F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("_p", "_q") for i in range(at_most)])
    gather = lambda c, n: F.array(*[F.col(f"{c}{i}") for i in range(n)])
    word_ref = gather("_q", at_most)
    return means.select("_lang", gather("_p", len(CLASSES)).alias("_class_ref"), F.filter(word_ref, lambda x: x.isNotNull()).alias("_word_ref"))


def beyond_chance(distance: Column, bins: Column, n: Column) -> Column:
    """``distance`` of a histogram of ``n`` draws without the divergence that sampling alone is expected to give."""
    return F.sqrt(F.greatest(distance * distance - (bins - 1) / (8 * math.log(2) * n), F.lit(0.0)))


def distances(c, class_ref: Column, word_ref: Column) -> tuple[Column, Column]:
    """Distances of the histograms of ``c`` (fields by name) from the references, NULL where not judged."""
    by_class = F.when((c["n_words"] >= LEAST_WORDS) & (total(c["_classes"]) > 0) & F.get(class_ref, F.lit(0)).isNotNull(),
                      jensen_shannon(shares(c["_classes"]), class_ref))
    by_word = F.when((c["n_words"] >= LEAST_WORDS) & (F.size(word_ref) == F.size(c["_common"])),
                     beyond_chance(jensen_shannon(shares(c["_common"]), word_ref), F.size(word_ref), c["n_words"]))
    return by_class, by_word


def accepted(c, by_class: Column, by_word: Column) -> Column:
    return ~c["base_failed"] & (F.coalesce(by_class, F.lit(0.0)) <= CLASS_LIMIT) & (F.coalesce(by_word, F.lit(0.0)) <= WORD_LIMIT)


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """``found`` with ``class_distance``, ``word_distance`` (NULL where not judged) and ``kept``."""
    joined = found.join(refs, "_lang", "left")
    by_class, by_word = distances(joined, F.col("_class_ref"), F.col("_word_ref"))
    out = joined.withColumns({"class_distance": by_class, "word_distance": by_word})
    return out.withColumn("kept", accepted(out, F.col("class_distance"), F.col("word_distance")))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and both distances.

    NULL, empty and blank texts have no words and fail.  A NULL language is one of
    its own without common words.  Repeated rows and NULL keys are judged as they
    come; other columns are ignored.  The counts are written once, so references and
    verdicts read the same rows.
    """
    found = written(features(docs, key, text, lang), "quality")
    return judged(found, references(found)).select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept", "class_distance", "word_distance")


def passing(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The references come from one pass over the counts (one row per language); the
    second pass judges each row where it is.  The verdict is one expression, so the
    filter computes the counts of a row once.
    """
    refs = written(references(features(docs, key, text, lang)), "references")
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_body"), _language(docs, lang).alias("_lang"))

    def verdict(c: Column) -> Column:
        return accepted(c, *distances(c, F.col("_class_ref"), F.col("_word_ref")))

    return carried.join(refs, "_lang", "left").where(let(described(F.col("_body"), F.col("_lang")), verdict)).select("_row.*")
