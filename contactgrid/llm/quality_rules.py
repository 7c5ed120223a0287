"""Quality rules: divergence from language references, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import let, materialize, spaced, words

#: Common words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "on", "with", "as", "be", "are", "was", "this", "by", "from", "or"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec", "pas"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "other")
#: Documents of fewer characters or words are not held against a reference.
MIN_CHARS, MIN_WORDS = 200, 100
#: The largest Jensen-Shannon distances (base 2, 0 to 1) that pass.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.29

_PLACE_BITS = 20


def _repeated_places(hashes: Column) -> Column:
    """The sorted places of the values that an array of longs holds twice or more.

    Each value's leading bits and its place share a long; sorted, equal values are neighbours. Where two
    different values share the leading bits, or places need more bits, pairs are sorted instead.
    """
    low = (1 << _PLACE_BITS) - 1
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(~low)) == 0

    def fast(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        near = lambda s, x, j, k: F.coalesce(same(x, F.get(s, j + k)), F.lit(False))
        return let(packed, lambda s: F.filter(s, lambda x, j: near(s, x, j, -1) | near(s, x, j, 1)))

    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def clash(h: Column, found: Column) -> Column:
        """Whether neighbours with equal leading bits differ."""
        other = lambda x, j: same(x, F.get(found, j + 1)) & (F.get(h, at(x)) != F.get(h, at(F.get(found, j + 1))))
        return F.exists(F.transform(found, lambda x, j: F.coalesce(other(x, j), F.lit(False))), lambda b: b)

    def slow(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        near = lambda s, p, j, k: F.coalesce(F.get(s, j + k)["x"] == p["x"], F.lit(False))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda p, j: near(s, p, j, -1) | near(s, p, j, 1)), lambda p: p["i"])))

    def places(h: Column) -> Column:
        quick = lambda found: F.when(clash(h, found), slow(h)).otherwise(F.sort_array(F.transform(found, at)))
        return F.when(F.size(h) > low, slow(h)).otherwise(let(fast(h), quick))

    return let(hashes, places)


def repeated_words(w: Column, n: int = 3) -> Column:
    """How many words stand in windows of n words that the array w holds twice or more."""
    none = F.array().cast("array<bigint>")
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n)))), F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    step = lambda p: F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(n)), F.lit(n)))
    covered = lambda h: let(_repeated_places(h), lambda p: F.aggregate(step(p), F.lit(0).cast("long"), lambda a, x: a + x))
    return let(F.coalesce(hashes, none), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def _classes(text: Column) -> Column:
    """The counts of CLASSES in a text, and of its n_symbols: each class is cut from what the one before leaves."""
    n = lambda a, b: (F.length(a) - F.length(b)).cast("long")
    cut = lambda x, pattern, body: let(F.regexp_replace(x, pattern, ""), body)

    def counts(lower, upper, digit, space, stop) -> Column:
        classes = F.array(n(text, lower), n(lower, upper), n(upper, digit), n(digit, space), n(space, stop), F.length(stop).cast("long"))
        return F.struct(classes.alias("classes"), n(space, F.regexp_replace(space, r"[#*$%&|<>]+", "")).alias("n_symbols"))

    stops = r"""[.,;:!?'"()-]+"""
    return cut(text, r"\p{Ll}+", lambda a: cut(a, r"\p{Lu}+", lambda b: cut(b, r"\p{N}+", lambda c: cut(c, r"[\x20\x09-\x0D]+", lambda e: cut(e, stops, lambda f: counts(a, b, c, e, f))))))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, in base 2, of two histograms as arrays of double; 0 if one has no counts."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    share = lambda h: let(_sum(h), lambda n: F.transform(h, lambda v: F.when(n > 0, v / n).otherwise(0.0)))
    both = F.zip_with(share(p), share(q), lambda x, y: part(x, y) + part(y, x))
    return F.when((_sum(p) > 0) & (_sum(q) > 0), F.sqrt(F.greatest(_sum(both) / 2, F.lit(0.0)))).otherwise(0.0)


def quality_rules(docs: DataFrame, carry: Sequence[str], common_words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """Documents with base counts, distances from their language's reference, and a verdict.

    Returns row (struct of ``carry``), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept. The histogram of character classes and that of the
    language's common words (other words in one more bin) are held against the sums of both over all
    documents of that language that don't fail the base, by Jensen-Shannon distance. A document fails at over MAX_CLASS_DISTANCE, given
    MIN_CHARS characters, or at over MAX_WORD_DISTANCE, given MIN_WORDS words.

    The counts are made in one pass and written without the texts; sums by language follow from them. Only
    languages of ``common_words`` have references, so these are that many rows at most, and broadcast.
    Null or empty text: no words, base_failed. Null or unknown lang: no reference, the base decides.
    Equal rows have equal results. No rows: no rows. Columns not in ``carry`` play no part.
    """
    k = max(map(len, common_words.values()))
    d = docs.select(F.struct(*carry).alias("row"), F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("body"))
    known = sorted({w for v in common_words.values() for w in v})
    fixed = F.array(*[F.lit("")] * k)
    for lang, list_ in common_words.items():
        fixed = F.when(F.col("lang") == lang, F.array(*map(F.lit, [*list_, *[""] * (k - len(list_))]))).otherwise(fixed)
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    times = lambda c: F.transform("fixed", lambda x: (F.size(c) - F.size(F.array_remove(c, x))).cast("long"))
    common = lambda s: F.filter(words(F.lower(s)), lambda x: x.isin(known))
    by_word = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    d = d.withColumn("fixed", fixed).withColumn("spaced", spaced(F.col("body")))
    d = d.select(
        "row", "lang", F.length("body").alias("n_chars"), let(words(F.col("spaced")), by_word).alias("m"), let(common(F.col("spaced")), times).alias("commons"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), _classes(F.col("body")).alias("c"),
    )
    d = d.select("row", "lang", "n_chars", "m.*", "commons", "n_dup_lines", "c.classes", "c.n_symbols", (F.col("n_chars") - F.col("c.classes")[3]).alias("word_chars"))
    d = materialize(d, "quality-counts")
    others = F.col("n_words") - F.aggregate("commons", F.lit(0).cast("long"), lambda a, v: a + v)
    d = d.withColumn("commons", F.concat("commons", F.array(others)))
    total = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n))).cast("array<double>").alias(f"ref_{c}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known_langs = d.where(F.col("lang").isin(list(common_words)) & ~failed)
    reference = known_langs.groupBy(F.col("lang").alias("ref_lang")).agg(total("classes", len(CLASSES)), total("commons", k + 1))
    d = d.join(F.broadcast(reference), F.col("lang") == F.col("ref_lang"), "left")
    for name in ("classes", "commons"):
        d = d.withColumn(f"distance_{name}", _distance(F.col(name).cast("array<double>"), F.col(f"ref_{name}")))
    d = d.withColumnsRenamed({"distance_classes": "class_distance", "distance_commons": "word_distance"})
    fits = ((F.col("n_chars") < MIN_CHARS) | (F.col("class_distance") <= MAX_CLASS_DISTANCE)) & ((F.col("n_words") < MIN_WORDS) | (F.col("word_distance") <= MAX_WORD_DISTANCE))
    return d.select(
        "row", "n_words", F.col("word_chars").cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("class_distance", F.lit(0.0)).alias("class_distance"), F.coalesce("word_distance", F.lit(0.0)).alias("word_distance"),
        (~failed & F.coalesce(fits, F.lit(True))).alias("kept"),
    )
