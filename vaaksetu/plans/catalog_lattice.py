"""Queries on lattices, over segments whose models hear variants of the words said.

Words of a segment differ from each other and variants never equal another place's words, so the cheapest alignment is place by place, which is
how the SQL counts votes and edits; the operator finds it by aligning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import LATTICE_NUMBERS, LATTICE_SPELLINGS
from ..operators import lattice
from ..sources.tables import spread
from . import reports
from .registry import listed, query, quoted, read, scratch

#: What is said at each place, and what models make of it; the last variant is noise of the place's own.
SLOTS = [
    ["चौदह", "14", "चोदह"], ["किताबें", "किताबे", "कताबें", "पुस्तकें"], ["खरीदीं", "खरीदी", "खरिदी"], ["बिल्कुल", "बिलकुल", "बीलकुल"], ["ज़्यादा", "ज्यादा", "ज्याद"], ["पाँच", "5", "पांच", "पंच"], ["लोग", "जन", "लौग"],
]
SYNONYMS = {"किताबें": ["पुस्तकें"], "लोग": ["जन"], "जन": ["लोग"]}
MODELS = ["m1", "m2", "m3", "m4"]
#: Words of a segment: places from FIRST on; a model may leave out the last word.
FIRST, LENGTH, MODEL_LENGTH = "k % 3", "k % 4 + 2", "k % 4 + 2 - (k % 10 = m)::INT"


def _said(k: Column) -> Column:
    words = F.lit([s[0] for s in SLOTS])
    return F.array_join(F.transform(F.sequence(F.lit(0), k % 4 + 1), lambda i: F.get(words, (k % 3 + i).cast("int"))), " ")


def _heard(k: Column, m: int) -> Column:
    """What model m hears: the word said two times in three, else a variant; where it leaves out the last word, it hears the others as they are."""
    slots = F.lit(SLOTS)
    last = k % 4 + 1 - (k % 10 == m).cast("int")

    def at(i: Column) -> Column:
        variants = F.get(slots, (k % 3 + i).cast("int"))
        pick = F.when(((k * 7 + m * 5 + i * 3) % 3 == 0) & (k % 10 != m), (k + m * i + 1) % F.size(variants)).otherwise(0)
        return F.get(variants, pick.cast("int"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), last), at), " ")
    return F.when(k % 17 == m, F.lit(None).cast("string")).when(k % 19 == m, "nan").when(k % 23 == m, " ").otherwise(text)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment a row: what was said, and a column a model; cells may be null, blank or the text nan, and so may what was said."""
    k = F.col("c_custkey").cast("int")
    said = F.when(k % 29 == 0, F.lit(None).cast("string")).when(k % 31 == 0, "nan").otherwise(_said(k))
    return spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("segment"), said.alias("Human"), *[_heard(k, m).alias(name) for m, name in enumerate(MODELS)])


def _slots() -> str:
    return "[" + ", ".join(map(listed, SLOTS)) + "]"


def _table(pairs: dict[str, list[str]]) -> str:
    return "VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, more in pairs.items() for b in more)


_DIGITS = LATTICE_NUMBERS | {w: [d] for d, ws in LATTICE_NUMBERS.items() for w in ws}
WORDS = f"""seg AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 29 <> 0 AND c_custkey % 31 <> 0),
  cells AS (SELECT k, m FROM seg, (SELECT unnest([0, 1, 2, 3]) AS m) WHERE k % 17 <> m AND k % 19 <> m AND k % 23 <> m),
  refs AS (SELECT k, unnest(range(0, {LENGTH})) AS i FROM seg),
  said AS (SELECT k, i, ({_slots()})[{FIRST} + i + 1] AS v FROM refs),
  spots AS (SELECT k, m, unnest(range(0, {MODEL_LENGTH})) AS i FROM cells),
  heard AS (SELECT a.k, m, a.i, v, v[CASE WHEN (a.k * 7 + m * 5 + a.i * 3) % 3 = 0 AND a.k % 10 <> m THEN (a.k + m * a.i + 1) % len(v) ELSE 0 END + 1] AS word FROM spots a JOIN said USING (k, i)),
  models AS (SELECT k, count(*) AS models FROM cells GROUP BY k),
  votes AS (SELECT k, i, word, count(*) AS votes FROM heard JOIN models USING (k) GROUP BY k, i, word, models HAVING count(*) >= greatest(1, ceil(models * 0.5)))"""


def bins_sql(synonyms: dict[str, list[str]] | None) -> str:
    steps = [("digits", _DIGITS)] + ([("synonyms", synonyms)] if synonyms else []) + [("spellings", LATTICE_SPELLINGS)]
    out, last = f"{WORDS},\n  bins0 AS (SELECT k, i, v[1] AS word FROM said WHERE k IN (SELECT k FROM cells) UNION SELECT k, i, word FROM votes)", "bins0"
    for n, (name, table) in enumerate(steps, 1):
        out += f",\n  {name}(a, b) AS ({_table(table)}), bins{n} AS (SELECT * FROM {last} UNION SELECT k, i, b FROM {last} JOIN {name} ON word = a)"
        last = f"bins{n}"
    return out + f",\n  bins AS (SELECT * FROM {last})"


def scores_sql(synonyms: dict[str, list[str]] | None) -> str:
    return f"""{bins_sql(synonyms)},
  sizes AS (SELECT k, m, {LENGTH} AS n, {LENGTH} - ({MODEL_LENGTH}) AS missing FROM cells),
  wrong AS (SELECT h.k, h.m, sum((h.word <> h.v[1])::INT) AS subs, sum((b.word IS NULL)::INT) AS outside FROM heard h LEFT JOIN bins b ON b.k = h.k AND b.i = h.i AND b.word = h.word GROUP BY h.k, h.m),
  scores AS (SELECT k, m, (subs + missing) / n AS standard, (outside + missing) / n AS lattice FROM sizes JOIN wrong USING (k, m))"""


@query(f"WITH {WORDS} SELECT k::VARCHAR AS segment, i::INT AS pos, word, votes FROM votes")
def lattice_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that at least half of a segment's models put at a place, by alignment."""
    from ..operators.alignment import align

    outputs = lattice.long_form(wide(spark, sf_dir))
    return lattice.consensus_votes(outputs.select("segment", "model", "hyp", align("ref", "hyp").alias("ops")))


@query(f"WITH {bins_sql(None)}, b AS (SELECT k, i, string_agg(word, '/' ORDER BY word) AS words FROM bins GROUP BY k, i) SELECT k::VARCHAR AS segment, string_agg(words, ' ' ORDER BY i) AS bins FROM b GROUP BY k")
def lattice_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice of each segment: the words said, agreed ones, numbers and spellings."""
    out = lattice.build_lattice(lattice.long_form(wide(spark, sf_dir)))
    return out.select("segment", F.array_join(F.transform("bins", lambda b: F.array_join(b, "/")), " ").alias("bins"))


@query(f"WITH {bins_sql(SYNONYMS)}, b AS (SELECT k, i, string_agg(word, '/' ORDER BY word) AS words FROM bins GROUP BY k, i) SELECT k::VARCHAR AS segment, string_agg(words, ' ' ORDER BY i) AS bins FROM b GROUP BY k")
def lattice_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with synonyms that the caller gives."""
    out = lattice.build_lattice(lattice.long_form(wide(spark, sf_dir)), synonyms=SYNONYMS)
    return out.select("segment", F.array_join(F.transform("bins", lambda b: F.array_join(b, "/")), " ").alias("bins"))


@query(f"WITH {scores_sql(None)} SELECT k::VARCHAR AS segment, 'm' || (m + 1) AS model, round(standard, 9) AS standard_wer, round(lattice, 9) AS lattice_wer FROM scores")
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rates of each model on each segment; missing cells have none."""
    outputs = lattice.long_form(wide(spark, sf_dir))
    return lattice.score_models(outputs, lattice.build_lattice(outputs)).withColumns({c: F.round(c, 9) for c in ("standard_wer", "lattice_wer")})


SUMMARY = f"{scores_sql(SYNONYMS)}, means AS (SELECT 'm' || (m + 1) AS model, avg(standard) AS s, avg(lattice) AS l, count(*) AS utterances FROM scores GROUP BY m)"


@query(f"WITH {SUMMARY} SELECT model, round(s, 9) AS standard_wer, round(l, 9) AS lattice_wer, round(s - l, 9) AS reduction, CASE WHEN s - l > 0.001 THEN '✓ Reduced' ELSE '— Unchanged' END AS status, utterances FROM means")
def lattice_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models over all segments, with synonyms."""
    return lattice.evaluate_models(wide(spark, sf_dir), synonyms=SYNONYMS).withColumns({c: F.round(c, 9) for c in ("standard_wer", "lattice_wer", "reduction")})


@query(f"WITH {SUMMARY} SELECT '| ' || model || ' | ' || printf('%.4f', s) || ' | ' || printf('%.4f', l) || ' | ' || printf('%.4f', s - l) || ' | ' || CASE WHEN s - l > 0.001 THEN '✓ Reduced' ELSE '— Unchanged' END || ' |' AS line FROM means")
def report_lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table in the report on lattices."""
    page = reports.lattices(lattice.evaluate_models(wide(spark, sf_dir), synonyms=SYNONYMS))
    return spark.createDataFrame([(line,) for line in page.split("\n") if line.startswith("| m")], "line string")


@query(f"WITH {scores_sql(None)} SELECT 'm' || (m + 1) AS model, count(*) AS utterances FROM scores GROUP BY m")
def csv_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table written as CSV and read again: how many utterances each model has."""
    from ..sources import tables

    path = scratch(spark, "models")
    tables.write_csv(wide(spark, sf_dir), path)
    return lattice.long_form(tables.read_csv(spark, path, multi_line=False)).groupBy("model").agg(F.count("*").alias("utterances"))
