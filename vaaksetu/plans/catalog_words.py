"""Queries on spelling, loan words and numbers, over words that keys put together from parts; their SQL works the rules out from the same fixed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loanwords, numbers, spelling
from ..functions.lexicon import APPROXIMATE, CORE_VOCABULARY, ENGLISH, IDIOMS, LOANS, NUMBER_WORDS, PREFIXES, ROMAN, ROMAN_PAIRS, SUFFIXES, UNITS
from ..operators import spelling as words_op
from . import reports
from .registry import listed, query, quoted, read, scratch

#: Parts of words: before, stem, after. Blank and punctuated ones are among them.
BEFORE = ["", "अन", "", "प्रति"]
STEMS = ["लोग", "बात", "है", "कर", "चीज़", "abc", "काा", "जॉब", "प्रोग्रामिंग", "टिकट", "हु", "बजत", "फ़ोन", "।", "स्टूडेंट", "मैसेज", "ज़्यादा", " "]
AFTER = ["", "ों", "वाला", "ें", "ता", "।", "पन", "्स"]


def word(key: str) -> Column:
    k = F.col(key)
    part = lambda of, at: F.get(F.lit(of), (F.floor(k / at) % len(of)).cast("int"))
    return F.concat(part(BEFORE, 1), part(STEMS, len(BEFORE)), part(AFTER, len(BEFORE) * len(STEMS)))


def _part(of: list[str], at: int) -> str:
    return f"({listed(of)})[k // {at} % {len(of)} + 1]"


WORD = " || ".join([_part(BEFORE, 1), _part(STEMS, len(BEFORE)), _part(AFTER, len(BEFORE) * len(STEMS))])
BLOCK = r"\x{0900}-\x{097F}"


def loan_sql(source: str) -> str:
    """CTE `loans`: the rows of source, whose column w is a word, with dev (its Devanagari), roman and method."""
    pairs = f"regexp_replace(w, '[^{BLOCK}]', '', 'g')"
    roman = "dev"
    for pair, letters in ROMAN_PAIRS.items():
        roman = f"replace({roman}, {quoted(pair)}, {quoted(letters)})"
    stems = sorted({e[:4] for e in ENGLISH if len(e) >= 4})
    return f"""bare AS (SELECT *, {pairs} AS dev FROM {source}),
  latin AS (SELECT *, lower(array_to_string(list_transform(regexp_extract_all({roman}, '(?s).'), lambda c: coalesce(({listed(ROMAN.values())})[list_position({listed(ROMAN)}, c)], c)), '')) AS roman FROM bare),
  loans AS (SELECT *, CASE WHEN dev = '' THEN 'empty' WHEN dev IN ({listed(sorted(LOANS))[1:-1]}) THEN 'dictionary' WHEN roman IN ({listed(sorted(ENGLISH))[1:-1]}) THEN 'transliteration'
    WHEN length(roman) >= 4 AND substring(roman, 1, 4) IN ({listed(stems)[1:-1]}) THEN 'fuzzy_transliteration' ELSE 'none' END AS method FROM latin)"""


VOCABULARY = listed(CORE_VOCABULARY)[1:-1]
FOLDED = "w"
for _dotted, _plain in (("ज़", "ज"), ("फ़", "फ"), ("ड़", "ड"), ("ढ़", "ढ")):
    FOLDED = f"replace({FOLDED}, {quoted(_dotted)}, {quoted(_plain)})"
ROOT = f"""(len(list_filter({listed(SUFFIXES)}, lambda s: ends_with(w, s) AND length(w) > length(s) + 1 AND list_contains([{VOCABULARY}], substring(w, 1, length(w) - length(s))))) > 0
    OR len(list_filter({listed(PREFIXES)}, lambda s: starts_with(w, s) AND length(w) > length(s) + 1 AND list_contains([{VOCABULARY}], substring(w, length(s) + 1)))) > 0)"""
#: The rules in their order: condition, class, confidence, reason.
RULES = [
    ("w = ''", "incorrect", "high", "'Empty string'"),
    ("""regexp_matches(w, '^[.,!?;:"''\\-()।॥]+$')""", "correct", "high", "'Punctuation token'"),
    (f"w IN ({VOCABULARY})", "correct", "high", "'Found in Hindi core vocabulary'"),
    (f"{FOLDED} IN ({VOCABULARY})", "correct", "high", "'Found after nuqta normalization'"),
    ("method NOT IN ('none', 'empty')", "correct", "high", "'English loan word (detected via ' || method || ')'"),
    (ROOT, "correct", "medium", "'Valid morphological derivation of known root'"),
    (f"NOT regexp_matches(w, '[{BLOCK}]') OR regexp_matches(w, '[\\x{{093E}}-\\x{{094C}}]{{2}}')", "incorrect", "high", "'Contains invalid Devanagari character sequences'"),
    ("length(w) <= 2", "correct", "low", "'Short word — may be valid particle or abbreviation'"),
    (f"length(w) >= 4 AND len(list_filter({listed(SUFFIXES)}, lambda s: ends_with(w, s))) > 0", "correct", "low", "'Has valid Hindi suffix but root not in dictionary'"),
    ("true", "incorrect", "low", "'Not found in any dictionary or pattern'"),
]
#: Each part's words are classified once each, as the operator does.
_CASE = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i] if i == 3 else quoted(r[i])}" for r in RULES) + " END"
JUDGED = f"""parts AS (SELECT p_partkey AS k FROM part), raw AS (SELECT k, {WORD} AS given, trim({WORD}) AS w FROM parts), {loan_sql("raw")},
  judged AS (SELECT k, given, w, method, {_CASE(1)} AS spelling, {_CASE(2)} AS confidence, {_CASE(3)} AS reason FROM loans),
  words AS (SELECT DISTINCT given, w AS word, spelling, confidence, reason FROM judged WHERE w <> '')"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), word("p_partkey").alias("given"))


@query(f"WITH {JUDGED} SELECT k, w AS word, spelling, confidence, reason FROM judged")
def spelling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, confidence and reason of each word, by the core vocabulary."""
    return _parts(spark, sf_dir).select("k", F.trim("given").alias("word"), spelling.classify_word(F.col("given")).alias("c")).select("k", "word", "c.*")


@query(f"WITH {JUDGED} SELECT word, spelling, confidence, reason FROM words")
def spelling_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of a list, made distinct before they are stripped, blank ones left out."""
    return words_op.classify_list(_parts(spark, sf_dir).select("given"))


@query(f"WITH {JUDGED} SELECT spelling, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM words GROUP BY spelling")
def spell_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_op.counts_by(words_op.classify_list(_parts(spark, sf_dir).select("given")), "spelling").withColumn("percent", F.round("percent", 6))


@query(f"WITH {JUDGED} SELECT l.confidence, count(w.word) AS n FROM (SELECT unnest(['high', 'medium', 'low']) AS confidence) l LEFT JOIN (SELECT * FROM words WHERE confidence <> 'medium') w USING (confidence) GROUP BY l.confidence")
def spell_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each confidence, zeros included: here words of medium confidence are taken out first."""
    return words_op.confidence_counts(words_op.classify_list(_parts(spark, sf_dir).select("given")).where("confidence <> 'medium'"))


@query(f"WITH {JUDGED} SELECT word, spelling, confidence, reason FROM words WHERE confidence = 'low' ORDER BY md5('42:' || word), word LIMIT 50")
def spell_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty words of low confidence to look at."""
    return words_op.review_low_confidence(words_op.classify_list(_parts(spark, sf_dir).select("given")))


@query("SELECT unnest({a}) AS category, unnest({b}) AS explanation".format(a=listed(c for c, _ in words_op.UNRELIABLE), b=listed(e for _, e in words_op.UNRELIABLE)))
def unreliable_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_op.unreliable_categories(spark)


@query(f"""WITH {JUDGED}, n AS (SELECT spelling, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS percent FROM words GROUP BY spelling)
SELECT '| ' || spelling || ' | ' || n AS head FROM n UNION ALL SELECT '| ' || confidence || ' | ' || count(*) FROM words GROUP BY confidence
UNION ALL SELECT '| review rows | ' || least(20, count(*)) FROM words WHERE confidence = 'low'""")
def report_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in the report on spelling, and how many rows of the review it shows."""
    page = reports.spellings(words_op.classify_list(_parts(spark, sf_dir).select("given")))
    counts, levels, review = (page.split(f"## {name}\n")[1].split("\n## ")[0] for name in ("Words", "Confidence", "Low confidence"))
    rows = lambda part: [line for line in part.split("\n") if line.startswith("| ")][1:]
    lines = [" | ".join(line.strip("| ").split(" | ")[:2]) for line in rows(counts) + rows(levels)] + [f"review rows | {len(rows(review))}"]
    return spark.createDataFrame([(f"| {line}",) for line in lines], "head string")


@query(f"WITH {JUDGED} SELECT DISTINCT given AS word FROM judged WHERE w <> ''")
def csv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of words written as CSV and read again by its first column."""
    from ..sources import tables

    path = scratch(spark, "words")
    tables.write_csv(_parts(spark, sf_dir).where("trim(given) <> ''").select("given", "k"), path)
    back = tables.read_csv(spark, path, multi_line=False)
    return back.select(F.col(back.columns[0]).alias("word")).distinct()


@query(f"WITH {JUDGED} SELECT k, method FROM judged")
def loan_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("k", loanwords.loan_method(F.col("given")).alias("method"))


@query(f"WITH parts AS (SELECT p_partkey AS k FROM part), raw AS (SELECT k, {WORD} AS w FROM parts), {loan_sql('raw')} SELECT k, roman FROM loans")
def romanized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import devanagari_only

    return _parts(spark, sf_dir).select("k", loanwords.romanize(devanagari_only(F.col("given"))).alias("roman"))


@query(f"""WITH parts AS (SELECT p_partkey AS k FROM part), raw AS (SELECT k, replace({WORD}, ' ', '') AS w FROM parts), {loan_sql("raw")}, t AS (SELECT k, dev, method NOT IN ('none', 'empty') AS loan FROM loans WHERE w <> ''),
  top AS (SELECT dev, count(*) AS n, min(k) AS first FROM t WHERE loan GROUP BY dev ORDER BY n DESC, first LIMIT 20)
SELECT count(*) AS total_words, count(*) FILTER (WHERE loan) AS english_words, round(count(*) FILTER (WHERE loan) / count(*), 9) AS english_ratio,
  (SELECT string_agg(dev || ':' || n, ',' ORDER BY n DESC, first) FROM top) AS top_words FROM t""")
def loan_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of loan words, and the most frequent ones, ties by where they first show."""
    out = words_op.loan_density(_parts(spark, sf_dir).select("k", F.replace("given", F.lit(" "), F.lit("")).alias("text")), order="k")
    shown = F.array_join(F.transform("top_words", lambda w: F.concat(w.word, F.lit(":"), w["count"].cast("string"))), ",")
    return out.select("total_words", "english_words", F.round("english_ratio", 9).alias("english_ratio"), shown.alias("top_words"))


EDGE = f"[^{BLOCK}\\p{{L}}]"
CORE = f"^({EDGE}*)(.*?)({EDGE}*)$"


@query(f"""WITH parts AS (SELECT p_partkey AS k FROM part), said AS (SELECT k, ['(' || trim({WORD}) || ')', trim({WORD}) || ',', 'x!'] AS t FROM parts),
  tokens AS (SELECT k, i, t[i] AS token, regexp_extract(t[i], '{CORE}', 1) AS a, regexp_extract(t[i], '{CORE}', 2) AS w, regexp_extract(t[i], '{CORE}', 3) AS z FROM (SELECT k, t, unnest([1, 2, 3]) AS i FROM said)), {loan_sql("tokens")}
SELECT k, string_agg(CASE WHEN w <> '' AND method NOT IN ('none', 'empty') THEN a || '[EN]' || w || '[/EN]' || z ELSE token END, ' ' ORDER BY i) AS tagged FROM loans GROUP BY k""")
def loan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan words tagged, brackets and commas outside of the tags."""
    w = F.trim("given")
    return _parts(spark, sf_dir).select("k", loanwords.tag_loans(F.concat(F.lit("("), w, F.lit(")  "), w, F.lit(",\tx!"))).alias("tagged"))


# Texts with numbers and what must become of them, as asserted or derived.
NUMBER_CASES = {
    "दो": "2", "दस": "10", "सौ": "100", "पच्चीस": "25", "तीन सौ चौवन": "354", "एक हज़ार": "1000", "दो-चार बातें करनी हैं": "दो-चार बातें करनी हैं",
    "मेरी उम्र पच्चीस साल है": "मेरी उम्र 25 साल है", "": "", "कोई संख्या नहीं": "कोई संख्या नहीं", "दो लाख तीन हज़ार चार सौ पच्चीस": "203425",
    "एक हज़ार रुपये दो": "1000 रुपये 2", "नौ दो ग्यारह हो गए": "नौ दो ग्यारह हो गए", "सौ नौ दो ग्यारह": "122", "हजारों लोग वहां थे": "1000ों लोग वहां थे",
    "हज़ारों लोग": "1000 लोग", "लाखों लोग": "लाखों लोग", "एक दो": "3", "दोस्त पीछे": "2स्त पी6", "एक करोड़ लाख": "10100000", "दो सौ सौ": "20000", "नौसौ": "9100", "उन्नतीस": "उन्न30",
}


@query(f"SELECT unnest({listed(NUMBER_CASES)}) AS said, unnest({listed(NUMBER_CASES.values())}) AS digits")
def number_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in NUMBER_CASES], "said string")
    return rows.select("said", numbers.normalize_numbers(F.col("said")).alias("digits"))


#: Words of lines with runs of number words, which words like that of a sentence end.
LINE = [*list(NUMBER_WORDS), "घर", "काम", "x"]
_PLACE = "(k * 31 + i * i * 17 + k // 7 * i) % {n} + 1"
#: Runs are summed by folding (total, now) over their words' values; a run that has an approximate number, or starts within an idiom, isn't here: words are chosen so that neither occurs.
SAFE = [w for w in LINE if w not in APPROXIMATE and not any(w in i.split() for i in IDIOMS)]
VALUES = [NUMBER_WORDS.get(w, -1) for w in SAFE]


@query(f"""WITH t AS (SELECT o_orderkey AS k, list_transform(range(1, 8), lambda i: {_PLACE.format(n=len(SAFE)).replace("k", "o_orderkey")}) AS spot FROM orders),
  w AS (SELECT k, i, ({listed(SAFE)})[spot[i]] AS word, ({VALUES})[spot[i]]::BIGINT AS v FROM (SELECT k, spot, unnest(range(1, 8)) AS i FROM t)),
  r AS (SELECT *, sum((v < 0)::INT) OVER (PARTITION BY k ORDER BY i) * 2 + (v >= 0)::INT AS run FROM w),
  g AS (SELECT k, run, min(i) AS i, v < 0 AS plain, list(struct_pack(total := 0::BIGINT, now := v) ORDER BY i) AS vs, string_agg(word, ' ' ORDER BY i) AS words FROM r GROUP BY k, run, v < 0),
  s AS (SELECT k, i, CASE WHEN plain THEN words ELSE (SELECT (f.total + f.now)::VARCHAR FROM (SELECT list_reduce(vs, lambda a, x: CASE WHEN x.now >= 1000 THEN struct_pack(total := a.total + CASE WHEN a.now = 0 THEN 1 ELSE a.now END * x.now, now := 0::BIGINT)
      WHEN x.now = 100 THEN struct_pack(total := a.total, now := CASE WHEN a.now = 0 THEN 1 ELSE a.now END * 100) ELSE struct_pack(total := a.total, now := a.now + x.now) END, struct_pack(total := 0::BIGINT, now := 0::BIGINT)) AS f)) END AS piece FROM g)
SELECT k, string_agg(piece, ' ' ORDER BY i) AS digits FROM s GROUP BY k""")
def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of seven words, number words and others, runs of number words as digits."""
    k = F.col("o_orderkey")
    at = lambda i: ((k * 31 + i * i * 17 + F.floor(k / 7) * i) % len(SAFE)).cast("int")
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.get(F.lit(SAFE), at(i))), " ")
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), line.alias("said"))
    return rows.select("k", numbers.normalize_numbers(F.col("said")).alias("digits"))


_ONES = [next(w for w, v in UNITS.items() if v == i) for i in range(10)]
_SMALL = listed([*_ONES, *[w for w, v in NUMBER_WORDS.items() if 10 <= v < 100]])


@query(f"""WITH t AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey < 1000000000)
SELECT n, trim(CASE WHEN n // 10000000 > 0 THEN ({_SMALL})[n // 10000000 + 1] || ' करोड़ ' ELSE '' END || CASE WHEN n // 100000 % 100 > 0 THEN ({_SMALL})[n // 100000 % 100 + 1] || ' लाख ' ELSE '' END
  || CASE WHEN n // 1000 % 100 > 0 THEN ({_SMALL})[n // 1000 % 100 + 1] || ' हज़ार ' ELSE '' END || CASE WHEN n // 100 % 10 > 0 THEN ({_SMALL})[n // 100 % 10 + 1] || ' सौ ' ELSE '' END
  || CASE WHEN n % 100 > 0 OR n = 0 THEN ({_SMALL})[n % 100 + 1] ELSE '' END) AS said FROM t""")
def numbers_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys in Hindi words."""
    return read(spark, sf_dir, "orders").where("o_orderkey < 1000000000").select(F.col("o_orderkey").alias("n"), numbers.spell_number(F.col("o_orderkey")).alias("said"))
