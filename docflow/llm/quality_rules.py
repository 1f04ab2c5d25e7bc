"""Quality rules: counts, and the divergence of a text from its language's reference.

Base rules count words, symbols, repeated lines and words in repeated five-word
windows.  Beyond them a document is compared with the reference of its language:
two histograms, of character classes and of common words, are held against the
medians of all documents of that language that the base rules pass, by Jensen-Shannon
distance (base 2, 0 to 1).  Documents under a minimum length are not judged by
divergence.  Every language has a reference of its own, drawn towards that of all languages
by the weight of ``PRIOR_DOCS`` documents: so a rare language leans on the whole corpus, and
there is no number of documents at which judging sets in.  One without a list of common
words here is judged by character classes alone.

Medians come from counts of shares in fixed bins, so they do not depend on how rows are
dealt to tasks.

All is done with DataFrame functions.  The corpus statistics are one small row a
language.  Languages are codes of two or three letters, so there are 18,253 rows at
most, of 300 bytes.

Defined results: a null text counts as empty, has no words and fails.  Of ``lang`` the
letters before a hyphen or underscore count, in lower case; null, and what is no code of
two or three letters a-z, is one language ``other``.  Rows are judged one by one, so repeats
and null ids need no care.  An empty table gives an empty result.  Other input
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import let, materialize

# Frequent function words of each language, twelve each.
COMMON_WORDS = {
    "cs": ["a", "je", "na", "v", "se", "to", "že", "s", "z", "do", "o", "i"],
    "da": ["og", "i", "at", "det", "er", "en", "til", "af", "på", "for", "med", "der"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "dans"],
    "it": ["di", "e", "il", "la", "che", "in", "a", "per", "un", "è", "del", "non"],
    "nl": ["de", "het", "een", "en", "van", "in", "is", "dat", "op", "te", "zijn", "met"],
    "pl": ["i", "w", "na", "z", "do", "się", "nie", "to", "że", "jest", "o", "po"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "os"],
    "ru": ["и", "в", "не", "на", "что", "с", "по", "как", "к", "он", "из", "у"],
    "sv": ["och", "i", "att", "det", "som", "en", "på", "är", "av", "för", "med", "till"],
    "tr": ["ve", "bir", "bu", "da", "de", "için", "ile", "o", "çok", "ne", "gibi", "daha"],
}
N_COMMON = 12
OTHER = "other"
#: The whole corpus, which is no language.
ALL = "all languages"
#: Character classes that are counted; the last class is what none of them has.
CLASSES = [r"\p{Lu}", r"\p{Nd}", r"""[.,;:!?'"()-]""", r"[#*$%&|<>]", r"[\x20\x09-\x0D]"]
SYMBOLS = CLASSES[3]
SPACE = r"[\x20\x09-\x0D]"
MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Words from which divergence is judged, and documents that the reference of all languages counts for in each.
MIN_WORDS = 50
PRIOR_DOCS = 20
#: Bins of a share, from 0 to 1.
BINS = 1 << 14
MAX_CHAR_DISTANCE = 0.18
MAX_WORD_DISTANCE = 0.4
#: Short texts scatter more: 1/n_words times this is added to both bounds.
LENGTH_SLACK = 3.0


def count_of(text: Column, klass: str) -> Column:
    """Characters of a class: what is left when runs of all others are cut."""
    others = f"[^{klass[1:-1]}]+" if klass.startswith("[") else f"[^{klass}]+"
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text, the first included."""

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def again(s: Column) -> Column:
        # Sorted (hash, place) pairs: a window repeats if a neighbour has its hash.
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def counted(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(let(pairs, again), covered))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), counted)))


def _language(lang: Column) -> Column:
    code = F.regexp_extract(F.lower(lang), r"^([a-z]{2,3})([-_].*)?$", 1)
    return F.when(code != "", code).otherwise(F.lit(OTHER))


def _common(language: Column) -> Column:
    """The common words of a language; none where the table has none."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for key, words in COMMON_WORDS.items():
        out = out.when(language == key, F.array(*map(F.lit, words)))
    return out.otherwise(F.array().cast("array<string>"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, language, the base counts and both histograms of every document."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language(lang).alias("language"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id",
        "language",
        words_of(text).alias("words"),
        # Letters in runs, lower-cased: words free of marks, for the common ones.
        F.split(F.lower(text), r"[^\p{L}]+").alias("letters"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(text).cast("long").alias("length"),
        *[count_of(text, k).alias(f"k{n}") for n, k in enumerate(CLASSES)],
    )
    common = let(_common(F.col("language")), lambda c: let(F.filter(F.col("letters"), lambda w: F.array_contains(c, w)), lambda own: F.transform(c, lambda w: F.size(F.filter(own, lambda x: x == w)).cast("long"))))
    n_letters = F.size(F.filter("letters", lambda w: w != "")).cast("long")
    known = sum((F.col(f"k{n}") for n in range(1, len(CLASSES))), F.col("k0"))
    rows = rows.select(
        "doc_id",
        "language",
        F.size("words").cast("long").alias("n_words"),
        (F.col("length") - F.col("k4")).alias("word_chars"),
        F.col("k3").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*[F.col(f"k{n}") for n in range(len(CLASSES))], F.col("length") - known).alias("chars"),
        common.alias("common"),
        n_letters.alias("n_letters"),
    )
    rest = F.col("n_letters") - F.aggregate("common", F.lit(0).cast("long"), lambda acc, x: acc + x)
    # Languages without a list have one class, so that their word distance is 0.
    none = F.array(*[F.lit(0).cast("long")] * N_COMMON)
    rows = rows.withColumn("common", F.when(F.size("common") > 0, F.col("common")).otherwise(none))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("common", F.concat("common", F.array(rest))).withColumn("base_failed", failed).drop("n_letters")


def references(feats: DataFrame) -> DataFrame:
    """One row a language: the median share of each class and word among documents that pass the base rules.

    Medians, not sums: junk that the base rules pass, and very long texts, do not
    move them.  A median is the least bin that half of the documents do not exceed.  That of the
    language counts as often as it has documents, that of all documents :data:`PRIOR_DOCS` times.
    """
    total = lambda c: F.greatest(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), F.lit(1.0))
    shares = lambda c, n: [F.floor(F.get(c, F.lit(k)) / total(c) * BINS).cast("int") for k in range(n)]
    n = len(CLASSES) + 1
    good = feats.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS))
    rows = good.select("language", F.posexplode(F.array(*shares("chars", n), *shares("common", N_COMMON + 1))).alias("slot", "bin"))
    # Counts by language first, a row a bin at most; the whole corpus is their sum.
    counts = rows.groupBy("language", "slot", "bin").agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.unionByName(counts.groupBy("slot", "bin").agg(F.sum("docs").alias("docs")).withColumn("language", F.lit(ALL)))
    within = Window.partitionBy("language", "slot")
    ranked = counts.withColumn("below", F.sum("docs").over(within.orderBy("bin"))).withColumn("all", F.sum("docs").over(within))
    medians = ranked.where(2 * F.col("below") >= F.col("all")).groupBy("language", "slot").agg(F.min("bin").alias("bin"), F.first("all").alias("docs"))
    pooled = medians.where(F.col("language") == ALL).select(F.col("slot").alias("p_slot"), F.col("bin").alias("p_bin"))
    drawn = (F.col("docs") * F.col("bin") + PRIOR_DOCS * F.col("p_bin")) / (F.col("docs") + PRIOR_DOCS)
    both = medians.where(F.col("language") != ALL).join(F.broadcast(pooled), F.col("slot") == F.col("p_slot"))  # one row a slot
    lists = both.groupBy("language").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", drawn.alias("value")))), lambda x: x["value"]).alias("values"))
    return lists.select("language", F.slice("values", 1, n).alias("ref_chars"), F.slice("values", n + 1, N_COMMON + 1).alias("ref_common"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null if one is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    both = F.zip_with(a, b, lambda x, y: F.struct((x / total(a)).alias("p"), (y / total(b)).alias("q")))
    terms = F.transform(both, lambda x: part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))
    spread = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(spread, F.lit(0.0))))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, both distances and the verdict."""
    feats = materialize(features(docs), "op8-features")
    judged = feats.join(F.broadcast(references(feats)), "language", "left")  # one row a language code
    judged = judged.withColumn("char_distance", distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
    slack = LENGTH_SLACK / F.greatest(F.col("n_words"), F.lit(1))
    far = (F.col("char_distance") > MAX_CHAR_DISTANCE + slack) | (F.col("word_distance") > MAX_WORD_DISTANCE + slack)
    kept = ~F.col("base_failed") & ~((F.col("n_words") >= MIN_WORDS) & F.coalesce(far, F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")
