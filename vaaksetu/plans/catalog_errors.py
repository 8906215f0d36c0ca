"""Queries on predictions and their errors, over utterances whose words keys choose from a short list; their SQL works the rules out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, text
from ..functions.lexicon import CATEGORIES, HOMOPHONES, MISMATCH_WORDS, REASONS
from ..operators import evaluation, taxonomy
from ..sources.tables import spread
from . import pipelines, reports
from .registry import SPLIT, edit_tables, listed, query, quoted, read, scratch

#: Words that utterances are made of: number words and digits, pairs that sound alike, Latin ones, punctuation.
SAID = ["दो", "2", "सौ", "घर", "घर।", "लोग", "वह", "वो", "ये", "यह", "app", "एप", "काम", "नाम", "है", "हैं", "पच्चीस", "25", "बहुत", "में", "मैं", "पानी", "की", "के"]
#: Lengths of a reference and of two predictions, and which word stands at place i (from 1), as SQL that both engines read.
LENGTHS = {"reference": "CASE WHEN k % 50 = 0 THEN 0 ELSE k % 6 + 1 END", "pretrained": "(k + k % 11) % 7 + 1", "finetuned": "CASE WHEN k % 50 = 0 THEN 0 ELSE k % 6 + 1 END + k % 9 % 3"}
PLAIN = "k * 5 + i * 7 + k % 23 * i"
PLACES = {
    "reference": PLAIN,
    "pretrained": f"CASE WHEN (k + i) % 3 = 0 THEN k * 3 + i * 11 ELSE {PLAIN} END",
    "finetuned": f"CASE WHEN (k % 97 + i) % 5 = 0 THEN k * 11 + i * 5 WHEN k % 13 = 0 AND i = 2 THEN {PLAIN.replace('i', '1')} ELSE {PLAIN} END",
}


def _text(side: str) -> Column:
    n = F.expr(LENGTHS[side].replace("k", "index")).cast("int")
    word = lambda i: F.get(F.lit(SAID), F.pmod(_place(side, i), F.lit(len(SAID))).cast("int"))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), word), " ")).otherwise("")


def _place(side: str, i: Column) -> Column:
    k = F.col("index")
    plain = lambda at: k * 5 + at * 7 + k % 23 * at
    if side == "pretrained":
        return F.when((k + i) % 3 == 0, k * 3 + i * 11).otherwise(plain(i))
    if side == "finetuned":
        return F.when((k % 97 + i) % 5 == 0, k * 11 + i * 5).when((k % 13 == 0) & (i == 2), plain(F.lit(1))).otherwise(plain(i))
    return plain(i)


def texts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(index, text): what is said, or what a model heard, for each customer."""
    return spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("index"))).select("index", _text(side).alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.predictions_table(*[texts(spark, sf_dir, side) for side in ("reference", "pretrained", "finetuned")])


def _side(side: str, k: str = "k") -> str:
    return f"list_transform(range(1, {LENGTHS[side]} + 1), lambda i: ({listed(SAID)})[({PLACES[side]}) % {len(SAID)} + 1])"


SAID_SQL = f"said AS (SELECT k, {_side('reference')} AS r, {_side('pretrained')} AS p, {_side('finetuned')} AS f FROM (SELECT c_custkey AS k FROM customer))"
SCORED = f"""{SAID_SQL}, {edit_tables("said", "pre")}, {edit_tables("pre", "fine", p="f")},
  scored AS (SELECT k, r, p, f, array_to_string(r, ' ') AS reference, array_to_string(p, ' ') AS pretrained, array_to_string(f, ' ') AS finetuned, e_pre, e_fine,
    CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE e_pre / len(r) END AS pre_wer, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE e_fine / len(r) END AS fine_wer FROM fine)"""


def mismatch_sql(a: str, b: str, r: str, h: str) -> str:
    """Whether numbers mismatch: lists of words a and b, texts r and h."""
    words = listed(MISMATCH_WORDS)
    return f"""(list_has_any(list_concat(list_filter({a}, lambda w: NOT list_contains({b}, w)), list_filter({b}, lambda w: NOT list_contains({a}, w))), {words})
      OR (regexp_matches({h}, '\\p{{Nd}}') AND NOT regexp_matches({r}, '\\p{{Nd}}')))"""


def categories_sql(a: str, b: str, r: str, h: str) -> str:
    """List of the categories of an error."""
    bare = lambda t: f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), ' \\n\\t')"
    alike = " OR ".join(f"(contains({r}, '{x}') AND contains({h}, '{y}')) OR (contains({r}, '{y}') AND contains({h}, '{x}'))" for x, y in HOMOPHONES)
    rules = [
        f"{bare(r)} = {bare(h)}", mismatch_sql(a, b, r, h), f"regexp_matches({r}, '[a-zA-Z]{{2,}}') <> regexp_matches({h}, '[a-zA-Z]{{2,}}')", alike,
        f"len(list_filter(range(1, len({b})), lambda i: {b}[i] = {b}[i + 1])) > 0", f"len({b}) < len({a}) * 0.7::DOUBLE", f"len({b}) > len({a}) * 1.3::DOUBLE",
    ]
    found = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN {quoted(name)} END" for name, rule in zip(CATEGORIES, rules)) + "], lambda c: c IS NOT NULL)"
    return f"(CASE WHEN len({found}) = 0 THEN ['Other'] ELSE {found} END)"


TURNS = f"turns AS (SELECT a.text AS r, b.text AS h, {SPLIT.format(c='a.text')} AS a, {SPLIT.format(c='b.text')} AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query(f"WITH {TURNS}, c AS (SELECT unnest({categories_sql('a', 'b', 'r', 'h')}) AS category FROM turns) SELECT category, count(*) AS n FROM c GROUP BY category")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each category occurs among consecutive turns, true counts."""
    c = read(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("reference")).join(nxt, ["conv_id", "turn"])
    return pairs.select(F.explode(errors.classify_error(F.col("reference"), F.col("prediction"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {SAID_SQL}, t AS (SELECT *, array_to_string(r, ' ') AS reference, array_to_string(f, ' ') AS heard FROM said) SELECT k AS index, array_to_string({categories_sql('r', 'f', 'reference', 'heard')}, ',') AS categories FROM t")
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All categories of each utterance's error, homophones and number words among them."""
    rows = texts(spark, sf_dir, "reference").withColumnRenamed("text", "r").join(texts(spark, sf_dir, "finetuned"), "index")
    return rows.select("index", F.array_join(errors.classify_error(F.col("r"), F.col("text")), ",").alias("categories"))


@query("SELECT unnest({names}) AS category, unnest({reasons}) AS reason".format(names=listed(REASONS), reasons=listed(REASONS.values())))
def error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in REASONS], "category string")
    return rows.select("category", errors.reason_for(F.col("category")).alias("reason"))


@query(f"WITH {SCORED} SELECT k AS index, reference, pretrained AS pretrained_prediction, finetuned AS finetuned_prediction, round(pre_wer, 9) AS pretrained_wer, round(fine_wer, 9) AS finetuned_wer, round(pre_wer - fine_wer, 9) AS wer_improvement FROM scored")
def predictions_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and two models' predictions joined by index, with error rates of each utterance."""
    return predictions(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("pretrained_wer", "finetuned_wer", "wer_improvement")})


@query(f"""WITH {SCORED}, s AS (SELECT sum(e_pre) AS pre, sum(e_fine) AS fine, sum(len(r)) AS n FROM scored)
SELECT 'Pretrained' AS model, printf('%.4f', pre / n) AS wer, '12.5' AS seconds FROM s UNION ALL SELECT 'Fine-tuned', printf('%.4f', fine / n), '8.0' FROM s""")
def wer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro rates of two models as printed; the times are the caller's."""
    out = evaluation.wer_report(predictions(spark, sf_dir), seconds={"pretrained": 12.5, "finetuned": 8.0})
    return out.select(F.col("Model").alias("model"), F.col("Hindi WER").alias("wer"), F.col("Inference Time (s)").alias("seconds"))


WORST = f"""top AS (SELECT *, row_number() OVER (ORDER BY fine_wer DESC, k) AS place FROM (SELECT * FROM scored WHERE fine_wer > 0 ORDER BY fine_wer DESC, k LIMIT 100)),
  step AS (SELECT greatest(1, max(place) // 25) AS step FROM top),
  picked AS (SELECT *, ((place - 1) // step)::INT AS sample_rank FROM top, step WHERE (place - 1) % step = 0 AND (place - 1) // step < 25),
  labelled AS (SELECT *, unnest({categories_sql("r", "f", "reference", "finetuned")}) AS category FROM picked)"""


@query(f"""WITH {SCORED}, {WORST}, n AS (SELECT category, count(*) AS n, min(sample_rank) AS first_order FROM labelled GROUP BY category),
  e AS (SELECT category, sample_rank, reference, finetuned, fine_wer, row_number() OVER (PARTITION BY category ORDER BY sample_rank) AS i FROM labelled)
SELECT category, n.n, row_number() OVER (ORDER BY n.n DESC, first_order) - 1 AS place, x.examples, ({listed(REASONS.values())})[list_position({listed(REASONS)}, category)] AS reasoning
FROM n JOIN (SELECT category, string_agg(reference || ' > ' || finetuned || ' ' || printf('%.3f', fine_wer), '; ' ORDER BY i) AS examples FROM e WHERE i <= 5 GROUP BY category) x USING (category)""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the worst errors by category, most frequent first, with examples and the category's reason."""
    out = taxonomy.taxonomy(taxonomy.label_errors(taxonomy.sample_errors(predictions(spark, sf_dir))))
    shown = F.transform("examples", lambda x: F.concat(x.reference, F.lit(" > "), x.prediction, F.lit(" "), F.format_string("%.3f", x.wer)))
    placed = out.limit(100).withColumn("place", F.monotonically_increasing_id())
    return placed.select("category", "n", "place", F.array_join(shown, "; ").alias("examples"), F.get("examples", F.lit(0)).reasoning.alias("reasoning"))


FIXED = f"""first AS (SELECT k, r, f, reference, finetuned FROM scored WHERE {mismatch_sql("r", "f", "reference", "finetuned")} ORDER BY k LIMIT 10),
  mended AS (SELECT *, replace(finetuned, 'दो', '2') AS mended, list_transform(f, lambda w: replace(w, 'दो', '2')) AS g FROM first), {edit_tables("mended", "before", p="f")}, {edit_tables("before", "after", p="g")},
  fixes AS (SELECT *, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE e_before / len(r) END AS wb, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE e_after / len(r) END AS wa FROM after)"""


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix is the caller's; here it writes one number word as a digit."""
    return evaluation.fix_results(predictions(spark, sf_dir), fix=lambda c: F.replace(c, F.lit("दो"), F.lit("2")))


@query(f"WITH {SCORED}, {FIXED} SELECT k AS index, reference, finetuned AS prediction_before, mended AS prediction_after, round(wb, 9) AS wer_before, round(wa, 9) AS wer_after, CASE WHEN wa < wb THEN '✓' ELSE '✗' END AS improved FROM fixes")
def fix_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten utterances whose numbers mismatch, before and after a fix."""
    return _fixes(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("wer_before", "wer_after")})


@query(f"WITH {SCORED}, {FIXED} SELECT round(avg(wb), 9) AS wer_before, round(avg(wa), 9) AS wer_after, count(*) FILTER (WHERE wa < wb) AS improved, count(*) AS rows FROM fixes")
def fix_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fix_means(_fixes(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("wer_before", "wer_after")})


@query(f"""WITH {SCORED}, {FIXED} SELECT substring(reference, 1, 8) || '...' AS reference, substring(finetuned, 1, 6) || '...' AS prediction_before, printf('%.3f', wb) AS wer_before, printf('%.3f', wa) AS wer_after,
  CASE WHEN wa < wb THEN '✓' ELSE '✗' END AS improved FROM fixes""")
def fix_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as printed: shortened texts, rates with three places."""
    out = evaluation.fix_table(_fixes(spark, sf_dir))
    return out.select(text.shorten(F.col("reference"), 8).alias("reference"), text.shorten(F.col("prediction_before"), 6).alias("prediction_before"), "wer_before", "wer_after", "improved")


@query(f"""WITH {SCORED}, s AS (SELECT sum(e_pre) AS pre, sum(e_fine) AS fine, sum(len(r)) AS n, count(*) AS utterances FROM scored)
SELECT unnest(['# Word error rates', '', '| Model | Hindi WER | Inference Time (s) |', '|---|---|---|', '| Pretrained | ' || printf('%.4f', pre / n) || ' | 12.5 |', '| Fine-tuned | ' || printf('%.4f', fine / n) || ' | 8.0 |', '',
  'Utterances: ' || utterances]) AS line, unnest(range(0, 8)) AS at FROM s""")
def report_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on error rates, line by line."""
    return _lines(spark, reports.wer(predictions(spark, sf_dir), {"pretrained": 12.5, "finetuned": 8.0}))


def _lines(spark: SparkSession, page: str) -> DataFrame:
    return spark.createDataFrame([(line, i) for i, line in enumerate(page.rstrip("\n").split("\n"))], "line string, at long")


@query(f"""WITH {SCORED}, {WORST}, {FIXED.replace("first AS", "early AS").replace("FROM first)", "FROM early)")}
SELECT (SELECT string_agg('## ' || category || ' (' || n || ')', '|' ORDER BY n DESC, o) FROM (SELECT category, count(*) AS n, min(sample_rank) AS o FROM labelled GROUP BY category)) AS heads,
  (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY category ORDER BY sample_rank) AS i FROM labelled) WHERE i <= 3) AS examples, (SELECT count(*) FROM fixes) AS fixes""")
def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, examples and rows of fixes in the report on errors. Its fix is the number fix, which doesn't choose the rows."""
    lines = reports.errors(predictions(spark, sf_dir)).split("\n")
    heads = [x for x in lines if x.startswith("## ") and x.endswith(")")]
    fixes = sum(x.endswith(("| ✓ |", "| ✗ |")) for x in lines)
    return spark.createDataFrame([("|".join(heads), sum(x.startswith("- reference: ") for x in lines), fixes)], "heads string, examples long, fixes long")


@query(f"WITH {SCORED} SELECT k AS index, reference, pretrained AS pretrained_prediction, finetuned AS finetuned_prediction, pre_wer AS pretrained_wer, fine_wer AS finetuned_wer, pre_wer - fine_wer AS wer_improvement FROM scored")
def csv_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as CSV and read again; empty texts are empty again."""
    from ..sources import tables

    path = scratch(spark, "predictions")
    tables.write_csv(predictions(spark, sf_dir), path)
    back = tables.read_predictions(spark, path)
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in back.columns if back.schema[c].dataType.simpleString() == "string"})


LABELS = "list_transform(range(0, k % 5 + 1), lambda i: CASE WHEN (k + i) % 4 = 0 THEN -100 ELSE (k * 3 + i) % 7 END)"
GUESSES = "list_transform(range(0, k % 6 + 1), lambda i: CASE WHEN (k + i) % 9 = 0 THEN 0 ELSE (k * 3 + i + (k + i) % 10 // 9) % 7 END)"


@query(f"""WITH x AS (SELECT c_custkey AS k FROM customer), y AS (SELECT list_transform(list_filter({LABELS}, lambda v: v > 0), lambda v: v::VARCHAR) AS r, list_transform(list_filter({GUESSES}, lambda v: v > 0), lambda v: v::VARCHAR) AS p FROM x), {edit_tables("y", "e")}
SELECT round(sum(e_e) / sum(len(r)) * 100, 9) AS wer FROM e""")
def training_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training metric over arrays of token ids with padding in both."""
    k = F.col("c_custkey").cast("int")
    ids = lambda n, f: F.transform(F.sequence(F.lit(0), n), f)
    labels = ids(k % 5, lambda i: F.when((k + i) % 4 == 0, -100).otherwise((k * 3 + i) % 7))
    guesses = ids(k % 6, lambda i: F.when((k + i) % 9 == 0, 0).otherwise((k * 3 + i + F.floor((k + i) % 10 / 9).cast("int")) % 7))
    return evaluation.training_wer(read(spark, sf_dir, "customer").select(labels.alias("labels"), guesses.alias("predictions"))).withColumn("wer", F.round("wer", 9))


@query(f"""WITH {SAID_SQL}, t AS (SELECT r, f, list_filter(list_transform(f, lambda w: regexp_replace(w, '[^\\x{{0900}}-\\x{{097F}}a-zA-Z0-9]', '', 'g')), lambda w: w <> '') AS c FROM said), {edit_tables("t", "raw", p="f")}, {edit_tables("raw", "clean", p="c")}
SELECT 'raw' AS step, sum(e_raw)::BIGINT AS edits, sum(len(r))::BIGINT AS words FROM clean UNION ALL SELECT 'clean', sum(e_clean)::BIGINT, sum(len(r))::BIGINT FROM clean""")
def cleanup_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning does to the error rate: edits with raw and with cleaned predictions."""
    rows = texts(spark, sf_dir, "reference").withColumnRenamed("text", "reference").join(texts(spark, sf_dir, "finetuned").withColumnRenamed("text", "prediction"), "index")
    return pipelines.cleanup_impact(rows).where("step in ('raw', 'clean')").select("step", "edits", "words")


@query("SELECT c_custkey AS k, c_custkey % 4 <> 3 AS missing FROM customer")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, blank and the text nan count as missing."""
    cell = F.get(F.array(F.lit(None).cast("string"), F.lit(" \t"), F.lit(" nan "), F.lit("nano")), F.col("c_custkey").cast("int") % 4)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.missing(cell).alias("missing"))


@query(f"SELECT unnest({listed(c for c, *_ in taxonomy.FIXES)}) AS category, unnest({listed(x for _, x, *_ in taxonomy.FIXES)}) AS proposal")
def fix_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.fix_proposals(spark).select("category", "proposal")
