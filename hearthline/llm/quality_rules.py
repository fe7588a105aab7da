"""Quality rules by counts and by distribution divergence, in DataFrame operations alone.

Some counts judge a text by itself: too few words, or too many of them in repeated windows. A
text that passes them is compared with its language: the shares of seven character classes, and the
shares of the language's most common words, against those of all its texts, by Jensen-Shannon
distance. Short texts stray by chance, by about 1 / words in the square, so the limits widen
as texts shorten, and texts below ``MIN_WORDS`` or ``MIN_CHARS``, as well as languages with
fewer than ``MIN_REFERENCE`` words, are not compared at all. Only texts of ``MIN_WORDS`` words
count for a reference.

Common words are the ``COMMON`` most frequent among words of at most ``SHORT`` code points, which
in languages that part words by blanks are the function words; ties go to the smaller. Tasks sum
them before the shuffle. What is joined to the texts is one row per language; Spark broadcasts it
where its written size allows and splits skewed partitions otherwise. Texts are read twice, once for
the common words and once for all counts, and never grouped or shuffled; the verdict works on stored counts.

Repeated windows are found by sorting only in texts where two windows have the same hash; windows
are then compared as words.

Null texts have no words. Every row gets a result of its own, repeated rows and rows without an id
too; null is a language of its own. Columns that a result would clash with give way to it. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import staged

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
# Character classes that are counted. Further ones are symbols, blanks, the bytes of characters beyond
# ASCII that follow their first, and all the rest.
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:?!'\"()\-]")
N_CLASSES = len(CLASSES) + 4

MIN_WORDS = 50
MIN_CHARS = 200
REPEATED_SHARE = 50
WINDOW = 3

COMMON = 16
SHORT = 4
MIN_REFERENCE = 2000

# Squares of the limits: a floor, and a part that falls with the number of words.
CLASS_LIMIT = (0.03, 3.0)
WORD_LIMIT = (0.03, 4.5)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "class_distance", "word_distance", "kept")


def words_of(text: Column) -> Column:
    """Runs of other than ASCII blanks; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def _neighbours(values: Column) -> Column:
    """Each two consecutive elements of an array as (x, y)."""
    less = F.greatest(F.size(values) - 1, F.lit(0))
    return F.arrays_zip(F.slice(values, 1, less).alias("x"), F.slice(values, 2, less).alias("y"))


def _windows(words: Column) -> Column:
    """Windows of three words as (a, b, c), in order."""
    many = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, many).alias(name) for k, name in enumerate("abc")])


def _sorted_windows(words: Column) -> Column:
    """Windows as (a, b, c, i), sorted, so that equal ones are neighbours."""
    many = F.size(words) - (WINDOW - 1)
    columns = [F.slice(words, k + 1, many).alias(name) for k, name in enumerate("abc")]
    return F.sort_array(F.arrays_zip(*columns, F.sequence(F.lit(1), many).alias("i")))


def _repeated_starts(windows: Column) -> Column:
    """Places of windows that equal another one, in order."""
    same = F.filter(_neighbours(windows), lambda p: (p.x.a == p.y.a) & (p.x.b == p.y.b) & (p.x.c == p.y.c))
    both = F.flatten(F.transform(same, lambda p: F.array(p.x.i, p.y.i)))
    return F.sort_array(F.array_distinct(both))


def _covered(starts: Column) -> Column:
    """Words that windows from these places cover."""
    gaps = F.transform(_neighbours(starts), lambda p: F.least(F.lit(WINDOW), p.y - p.x))
    return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap))


def _repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return F.size(lines) - F.size(F.array_distinct(lines))


def _class_counts(text: Column, word_chars: Column, symbols: Column) -> Column:
    chars = F.length(text)
    counted = [*[F.regexp_count(text, F.lit(c)) for c in CLASSES], symbols, chars - word_chars]
    values = [*counted, F.octet_length(text) - chars, chars - sum(counted[1:], counted[0])]
    return F.array(*[v.cast("long") for v in values])


def distance_squared(left: Column, right: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two arrays of shares: the square of the distance."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(left, right, lambda x, y: part(x, y) + part(y, x))
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term) / 2


def _shares(counts: Column, whole: Column) -> Column:
    return F.transform(counts, lambda n: n.cast("double") / whole)


def _same_language() -> Column:
    return F.col("lang").eqNullSafe(F.col("_lang"))


def _same_language() -> Column:
    return F.col("_of").eqNullSafe(F.col("_lang"))


def common_words(texts: DataFrame) -> DataFrame:
    """(_lang, total, common): a language's words in all, and its common ones as (word, n) by falling n.

    Takes (_of, text), and counts texts of enough words.
    """
    split = texts.select("_of", words_of(F.col("text")).alias("words"))
    counted = split.select("_of", F.when(F.size("words") >= MIN_WORDS, F.col("words")).alias("words"))
    # The outer form keeps Spark from splitting each text once more to filter it.
    single = counted.select("_of", F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())
    short = F.when(F.length("word") <= SHORT, F.col("word"))
    counts = single.groupBy("_of", short.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "words")
    totals = counts.groupBy(F.col("_of").alias("_lang")).agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("_of").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("word").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= COMMON)
    lists = top.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("common"))
    empty = F.array().cast("array<struct<rank:int,word:string,n:bigint>>")
    held = totals.join(lists, _same_language(), "left")
    return held.select("_lang", "total", F.coalesce("common", empty).alias("common"))


def _word_shares() -> Column:
    """Shares of the common words in their language, then that of all other words."""
    counts = F.transform("common", lambda c: c.n)
    rest = F.col("total") - F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)
    return _shares(F.concat(counts, F.array(rest)), F.col("total"))


def _limit(limit: tuple[float, float]) -> Column:
    return F.lit(limit[0]) + F.lit(limit[1]) / F.col("n_words")


def judged(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carried: Sequence[str] | None = None
) -> DataFrame:
    """The rows of docs with the counts, ``base_failed``, the two distances and ``kept``.

    Distances are null where no comparison takes place; such a text is kept if the counts allow it.
    Rows are stored once on the way; ``carried`` names the columns to keep, all by default.
    """
    names = docs.columns if carried is None else carried
    own = [F.col(f"`{n}`") for n in names if n not in RESULTS]
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    known = common_words(docs.select(lang.alias("_of"), text.alias("text"))).where(F.col("total") >= MIN_REFERENCE)
    known = staged(known.select("_lang", F.transform("common", lambda c: c.word).alias("common"), _word_shares().alias("word_shares")), "common")
    counted = _counted(docs.select(F.struct(*own).alias("_row"), lang.alias("_of"), F.coalesce(text, F.lit("")).alias("_text")), known)
    counted = staged(counted, "counted")

    parts = [F.sum(F.when(F.col("n_words") >= MIN_WORDS, F.col("_classes")[i])) for i in range(N_CLASSES)]
    sums = counted.groupBy(F.col("_of").alias("_lang")).agg(F.array(*parts).alias("sums"))
    reference = staged(sums.select("_lang", _shares(F.col("sums"), _total("sums")).alias("class_shares")), "classes")
    rows = counted.join(reference, _same_language(), "left")

    compared = F.col("_hits").isNotNull()
    rest = F.col("n_words") - _total("_hits")
    by_word = _shares(F.concat("_hits", F.array(rest)), F.col("n_words").cast("double"))
    by_class = _shares(F.col("_classes"), _total("_classes").cast("double"))
    rows = rows.withColumn("_class", F.when(compared, distance_squared(by_class, F.col("class_shares"))))
    rows = rows.withColumn("_word", F.when(compared, distance_squared(by_word, F.col("word_shares"))))
    strays = (F.col("_class") > _limit(CLASS_LIMIT)) | (F.col("_word") > _limit(WORD_LIMIT))
    # Rounding may leave a square just below zero.
    squares = {n: F.when(F.col(f"_{n}") < 0, 0.0).otherwise(F.col(f"_{n}")) for n in ("class", "word")}
    distances = [F.sqrt(square).alias(f"{n}_distance") for n, square in squares.items()]
    kept = ~F.col("base_failed") & ~F.coalesce(strays, F.lit(False))
    return rows.select("_row.*", *COUNTS, "base_failed", *distances, kept.alias("kept"))


def _total(array: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, n: total + n)


def _counted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of each text: (_row, _of, word_shares, the counts, base_failed, _classes, _hits)."""
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    rows = rows.withColumn("_hashes", F.transform(_windows(F.col("_words")), lambda w: F.xxhash64(w)))
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    starts = F.when(again, _repeated_starts(_sorted_windows(F.col("_words"))))
    rows = rows.withColumn("_starts", F.coalesce(starts, F.array().cast("array<int>")))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)),
        "n_dup_lines": _repeated_lines(F.col("_text")),
        "n_repeat_words": _covered(F.col("_starts")),
    }
    rows = rows.select("_row", "_of", "_text", "_words", *[c.cast("long").alias(n) for n, c in counts.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).join(known, _same_language(), "left")
    compared = ~F.col("base_failed") & F.col("common").isNotNull() & (F.col("word_chars") >= MIN_CHARS)
    hits = F.transform("common", lambda c: (F.size("_words") - F.size(F.array_remove("_words", c))).cast("long"))
    classes = _class_counts(F.col("_text"), F.col("word_chars"), F.col("n_symbols"))
    return rows.select(
        "_row", "_of", "word_shares", *COUNTS, "base_failed", classes.alias("_classes"), F.when(compared, hits).alias("_hits")
    )


def kept(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents that pass, with the columns of docs."""
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    rows = docs.select(whole.alias("_doc"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return judged(rows).where("kept").select("_doc.*")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         [len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[0-9]')),
          len(regexp_extract_all(text, '[.,;:?!''"()\-]')), len(regexp_extract_all(text, '[#*$%&|<>]')),
          len(regexp_extract_all(text, '[\x20\x09-\x0D]'))] AS counted
  FROM docs
), tokens AS (
  SELECT id, lang, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
), windows AS (
  SELECT id, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM tokens WINDOW p AS (PARTITION BY id ORDER BY i)
), starts AS (
  SELECT id, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY id, a, b, c) > 1
), covered AS (
  SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM starts, range(3) r(k) GROUP BY id
), base AS (
  SELECT s.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, list_concat(counted, [strlen(text) - length(text), length(text) - list_sum(counted)]) AS classes
  FROM split s LEFT JOIN covered c ON s.id = c.id
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), word_counts AS (
  SELECT lang, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total
  FROM tokens WHERE n_words >= 50 GROUP BY lang, word
), common AS (
  SELECT lang, word, n / total AS y FROM word_counts WHERE length(word) <= 4 AND total >= 2000
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 16
), rests AS (
  SELECT t.lang, 1 - coalesce(sum(c.y), 0) AS y
  FROM (SELECT lang FROM word_counts GROUP BY lang HAVING sum(n) >= 2000) t LEFT JOIN common c ON t.lang IS NOT DISTINCT FROM c.lang
  GROUP BY t.lang
), class_sums AS (
  SELECT lang, k, sum(classes[k]) AS n, sum(sum(classes[k])) OVER (PARTITION BY lang) AS total
  FROM base, range(1, 8) r(k) WHERE n_words >= 50 GROUP BY lang, k
), class_shares AS (
  SELECT f.id, f.classes[c.k] / strlen(f.text) AS x, c.n / c.total AS y
  FROM failed f JOIN class_sums c ON f.lang IS NOT DISTINCT FROM c.lang
  WHERE NOT base_failed AND f.word_chars >= 200
), hits AS (
  SELECT t.id, t.word, count(*) AS n FROM tokens t JOIN common c ON t.lang IS NOT DISTINCT FROM c.lang AND t.word = c.word GROUP BY ALL
), common_shares AS (
  SELECT f.id, coalesce(h.n, 0) / f.n_words AS x, c.y
  FROM failed f JOIN common c ON f.lang IS NOT DISTINCT FROM c.lang LEFT JOIN hits h ON h.id = f.id AND h.word = c.word
  WHERE NOT base_failed AND f.word_chars >= 200
), word_shares AS (
  SELECT * FROM common_shares
  UNION ALL
  SELECT f.id, 1 - coalesce((SELECT sum(n) FROM hits h WHERE h.id = f.id), 0) / f.n_words, r.y
  FROM failed f JOIN rests r ON f.lang IS NOT DISTINCT FROM r.lang WHERE NOT base_failed AND f.word_chars >= 200
), parts AS (
  SELECT id, 'class' AS kind, x, y FROM class_shares UNION ALL SELECT id, 'word', x, y FROM word_shares
), distances AS (
  SELECT id, kind, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2 AS d
  FROM parts GROUP BY id, kind
), verdicts AS (
  SELECT f.*, NOT base_failed AND coalesce(c.d <= 0.03 + 3.0 / n_words, true) AND coalesce(w.d <= 0.03 + 4.5 / n_words, true) AS kept
  FROM failed f LEFT JOIN distances w ON w.id = f.id AND w.kind = 'word'
  LEFT JOIN distances c ON c.id = f.id AND c.kind = 'class' AND w.id IS NOT NULL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts
"""
