"""Quality rules: base repetition and length rules, then divergence of a document's character-class and
common-word histograms from its language's references. DataFrame and SQL functions only.

References are estimated from the whole corpus: the summed histograms of each language's documents
that pass the base rules. A document's distance is the square root of the base-2 Jensen-Shannon
divergence. Guards: a histogram of fewer than ``min_chars`` characters or ``min_words`` words isn't judged.

Repetition works inside the row: windows of three words are hashed (64 bits), sorted, and equal neighbours
marked, so a text of any length needs no shuffle.

Edge cases: a null text is an empty one (no words: base_failed); an unknown or null language is a language
of its own for the character classes and has no common-word rule; a language without documents that pass
has no reference, and its documents are judged by the base rules alone; repeated ids are separate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._common import WORD, materialize

#: Frequent function words of each language; their frequencies come from the corpus.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em"],
    "it": ["di", "e", "il", "la", "che", "in", "un", "per"],
    "nl": ["de", "van", "het", "een", "en", "in", "is", "dat"],
    "sv": ["och", "i", "att", "det", "som", "en", "av", "den"],
    "pl": ["w", "i", "na", "z", "do", "nie", "o", "jest"],
    "tr": ["ve", "bir", "bu", "da", "de", "ile", "olarak", "olan"],
}
N_COMMON = 8
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
SPACE = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "punct", "space", "other")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gone(expr: str, chars: str) -> str:
    """Characters of expr that are among chars."""
    return f"(length({expr}) - length(translate({expr}, {_quoted(chars)}, '')))"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the counts, and the histograms cls (character classes) and com (common words and the rest)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # words; only the ends can be empty strings, and the trim takes those
    d = d.withColumn("w", F.expr(f"split(btrim(t, {_quoted(SPACE)}), '[\\\\x20\\\\x09-\\\\x0D]+', -1)"))
    d = d.withColumn("n", F.expr("CASE WHEN size(w) = 1 AND w[0] = '' THEN 0 ELSE size(w) END"))
    # what is left without lower-case letters, then without blanks as well, is short: the other classes are counted there
    d = d.withColumn("x", F.expr(r"regexp_replace(t, '\\p{Ll}+', '')")).withColumn("y", F.expr("replace(x, ' ', '')"))
    d = d.withColumn("h", F.expr("CASE WHEN n < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, n - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) END"))
    # values that occur twice; null where none does
    d = d.withColumn("o", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(h) END"))
    d = d.withColumn("v", F.expr("array_distinct(filter(o, (x, k) -> coalesce(x = get(o, k - 1), false)))"))
    # every start of such a window, in order: by look-up among few values, else by sorting
    d = d.withColumn(
        "s",
        F.expr("CASE WHEN size(v) > 24 THEN sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))) END"),
    )
    by_sort = "sort_array(transform(filter(s, (x, k) -> coalesce(x.h = get(s, k - 1).h, false) OR coalesce(x.h = get(s, k + 1).h, false)), x -> x.i))"
    by_look = "filter(transform(h, (x, i) -> CASE WHEN array_contains(v, x) THEN i END), i -> i IS NOT NULL)"
    d = d.withColumn("r", F.expr(f"CASE WHEN v IS NULL THEN 0L ELSE aggregate(CASE WHEN s IS NULL THEN {by_look} ELSE {by_sort} END, named_struct('c', 0L, 'p', -3), (a, i) -> named_struct('c', a.c + least(3, i - a.p), 'p', i), a -> a.c) END"))
    d = d.withColumn("ls", F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    rest = ", ".join(f"'{lang}', array({', '.join(_quoted(x) for x in ws)})" for lang, ws in COMMON.items())
    d = d.withColumn("ref", F.expr(f"element_at(map({rest}), lang)"))
    # every word between two blanks of its own
    d = d.withColumn("u", F.expr(r"CASE WHEN ref IS NOT NULL THEN concat(' ', lower(regexp_replace(t, '[\\x20\\x09-\\x0D.,;:!?\"()]+', '  ')), ' ') END"))
    found = [f"cast((octet_length(u) - octet_length(replace(u, concat(' ', ref[{k}], ' '), ''))) / (octet_length(ref[{k}]) + 2) AS long)" for k in range(N_COMMON)]
    d = d.withColumn("com", F.expr(f"CASE WHEN ref IS NOT NULL THEN array({', '.join(found)}) END"))
    d = d.withColumn("space", F.expr(f"length(x) - length(y) + {_gone('y', SPACE)}"))
    d = d.withColumn("cls", F.expr(f"array(length(t) - length(x), length(y) - length(regexp_replace(y, '\\\\p{{Lu}}+', '')), {_gone('y', '0123456789')}, {_gone('y', PUNCTUATION)}, space)"))
    return d.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.expr("cast(length(t) - space AS long)").alias("word_chars"),
        F.expr(f"cast({_gone('y', SYMBOLS)} AS long)").alias("n_symbols"),
        F.expr("cast(size(ls) - size(array_distinct(ls)) AS long)").alias("n_dup_lines"),
        F.col("r").alias("n_repeat_words"),
        F.expr("transform(concat(cls, array(length(t) - aggregate(cls, 0, (a, c) -> a + c))), c -> cast(c AS long))").alias("cls"),
        F.expr("CASE WHEN com IS NOT NULL THEN concat(com, array(greatest(0L, n - aggregate(com, 0L, (a, c) -> a + c)))) END").alias("com"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def references(feats: DataFrame) -> DataFrame:
    """Summed histograms of the rows given: a row per language."""
    n_com = N_COMMON + 1
    sums = [F.sum(F.col("cls")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.get(F.col("com"), F.lit(i))).alias(f"w{i}") for i in range(n_com)]
    return feats.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"),
        F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_cls"),
        F.when(F.col("w0").isNotNull(), F.array(*[f"w{i}" for i in range(n_com)])).alias("ref_com"),
    )


def js_distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two count arrays; null if either is empty."""
    def norm(a: str) -> str:
        return f"transform({a}, x -> x / cast(aggregate({a}, 0L, (s, y) -> s + y) AS double))"

    def term(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((pq.p + pq.q) / 2D)) ELSE 0D END"

    total = f"aggregate(zip_with({norm(p)}, {norm(q)}, (p, q) -> named_struct('p', p, 'q', q)), 0D, (a, pq) -> a + {term('pq.p')} + {term('pq.q')})"
    return f"CASE WHEN aggregate({p}, 0L, (s, y) -> s + y) > 0 AND aggregate({q}, 0L, (s, y) -> s + y) > 0 THEN sqrt(greatest({total} / 2D, 0D)) END"


def _distances(feats: DataFrame, refs: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    d = feats.join(refs, feats["lang"].eqNullSafe(refs["ref_lang"]), "left")
    return d.withColumn("class_distance", F.expr(f"CASE WHEN word_chars >= {min_chars} THEN {js_distance('cls', 'ref_cls')} END")).withColumn(
        "common_distance", F.expr(f"CASE WHEN n_words >= {min_words} THEN {js_distance('com', 'ref_com')} END")
    )


def judge(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_class=0.16, max_common=0.45, trim=0.15, min_chars=200, min_words=50) -> DataFrame:
    """Counts, base_failed, class_distance, common_distance (null where not judged) and kept for each row.

    The first references sum the documents that pass the base rules; the final ones only those of them
    that lie within ``trim`` of the first, so that odd documents don't shape what they are held against.
    """
    feats = materialize(features(docs, id_col, text_col, lang_col), "rules")
    first = _distances(feats.where(~F.col("base_failed")), references(feats.where(~F.col("base_failed"))), min_chars, min_words)
    d = _distances(feats, references(first.where(f"class_distance <= {trim}")), min_chars, min_words)
    ok = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class) & (F.coalesce(F.col("common_distance"), F.lit(0.0)) <= max_common)
    return d.withColumn("kept", ~F.col("base_failed") & ok).drop("ref_lang", "ref_cls", "ref_com")
