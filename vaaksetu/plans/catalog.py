"""The queries over the driver's tables and their DuckDB counterparts.

The tables hold no Hindi, so queries of Hindi functions run on text spelled from the tables' integers or on words that keys
choose; their SQL works the result out from the same keys. Queries on errors, words, lattices and files have modules of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, numbers, text, wer
from ..functions.lexicon import HOMOPHONES
from ..operators import evaluation, lattice, manifest, taxonomy
from ..operators import spelling as words_op
from ..operators.alignment import align
from ..sources.tables import spread
from . import catalog_data, catalog_errors, catalog_lattice, catalog_words  # noqa: F401  their queries register on import
from .registry import ORACLE_SQL, QUERIES, SPLIT, edit_tables, query, read  # noqa: F401

def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a reference and the next one of its conversation as a prediction; joined by key, not by position."""
    c = read(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("reference")).join(nxt, ["conv_id", "turn"])


def _words(c: str) -> Column:
    return text.tokens(F.col(c))


PAIRS = f"""
  pairs AS (SELECT a.conv_id, a.turn, a.role, a.text AS reference, b.text AS prediction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  cut AS (SELECT *, {SPLIT.format(c="reference")} AS r, {SPLIT.format(c="prediction")} AS p, len(r)::BIGINT AS n FROM pairs), {edit_tables("cut", "edits")}"""


@query(f"WITH {PAIRS} SELECT conv_id, turn, role, e_edits AS edits, n AS words, CASE WHEN n > 0 THEN round(e_edits / n, 9) WHEN len(p) = 0 THEN 0 ELSE 'Infinity'::DOUBLE END AS wer FROM edits")
def std_wer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", "role", _words("reference").alias("r"), _words("prediction").alias("p"))
    return rows.select("conv_id", "turn", "role", wer.word_edits(F.col("r"), F.col("p")).alias("edits"), F.size("r").cast("long").alias("words"), F.round(wer.standard_wer(F.col("r"), F.col("p")), 9).alias("wer"))


@query(f"WITH {PAIRS} SELECT role, sum(e_edits)::BIGINT AS edits, sum(n)::BIGINT AS words, round(sum(e_edits) / sum(n), 9) AS wer FROM edits GROUP BY role")
def corpus_wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).select("role", F.array_join(_words("reference"), " ").alias("reference"), F.array_join(_words("prediction"), " ").alias("prediction"))
    return evaluation.corpus_wer(pairs, "role").withColumn("wer", F.round("wer", 9))


@query(f"WITH {PAIRS} SELECT role, round(avg(w), 9) AS standard_wer, round(avg(w), 9) AS lattice_wer, count(*) AS utterances FROM (SELECT role, CASE WHEN n > 0 THEN e_edits / n WHEN len(p) = 0 THEN 0 ELSE 'Infinity'::DOUBLE END AS w FROM edits) GROUP BY role")
def macro_wer_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice edits against bins of one word each are plain edits, so both rates agree."""
    rows = turn_pairs(spark, sf_dir).select(F.col("role").alias("model"), _words("reference").alias("r"), _words("prediction").alias("p"))
    bins = F.transform("r", lambda w: F.array(w))
    scores = rows.select("model", wer.standard_wer(F.col("r"), F.col("p")).alias("standard_wer"), wer.lattice_wer(bins, F.col("p")).alias("lattice_wer"))
    out = lattice.summarize_models(scores)
    return out.select(F.col("model").alias("role"), F.round("standard_wer", 9).alias("standard_wer"), F.round("lattice_wer", 9).alias("lattice_wer"), "utterances")


@query(f"WITH {PAIRS} SELECT conv_id, turn, e_edits AS edits FROM edits")
def alignment_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the alignment that aren't matches: as many as there are edits."""
    rows = turn_pairs(spark, sf_dir).select("conv_id", "turn", align(_words("reference"), _words("prediction")).alias("ops"))
    return rows.select("conv_id", "turn", F.size(F.filter("ops", lambda o: o.op != "M")).cast("long").alias("edits"))


@query(f"""
WITH t AS (SELECT conv_id, turn, {SPLIT.format(c="text")} AS w FROM conversations),
u AS (SELECT conv_id, turn, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
m AS (SELECT conv_id, count(*) AS models FROM t WHERE len(w) > 0 GROUP BY conv_id)
SELECT conv_id, i::INT - 1 AS pos, word, count(*) AS votes FROM u JOIN m USING (conv_id) GROUP BY conv_id, i, word, models HAVING count(*) >= greatest(1, ceil(models * 0.5))""")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation vote on its words, place by place."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("segment"), F.col("turn").alias("model"), _words("text").alias("hyp")).where(F.size("hyp") > 0)
    same = F.transform("hyp", lambda w, i: F.struct(F.lit("M").alias("op"), i.cast("int").alias("ref_pos"), i.cast("int").alias("hyp_pos")))
    return lattice.consensus_votes(rows.withColumn("ops", same)).withColumnRenamed("segment", "conv_id")


ALIKE = " OR ".join(f"(contains(r, '{x}') AND contains(h, '{y}')) OR (contains(r, '{y}') AND contains(h, '{x}'))" for x, y in HOMOPHONES)


@query(rf"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS r, b.text AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
t AS (SELECT *, {SPLIT.format(c="r")} AS a, {SPLIT.format(c="h")} AS b FROM p)
SELECT conv_id, turn, trim(regexp_replace(r, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), ' \n\t') = trim(regexp_replace(h, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), ' \n\t') AS c1,
  {catalog_errors.mismatch_sql('a', 'b', 'r', 'h')} AS c2, regexp_matches(r, '[a-zA-Z]{{2,}}') <> regexp_matches(h, '[a-zA-Z]{{2,}}') AS c3, {ALIKE} AS c4,
  len(list_filter(range(1, len(b)), lambda i: b[i] = b[i + 1])) > 0 AS c5, len(b) < len(a) * 0.7 AS c6, len(b) > len(a) * 1.3 AS c7 FROM t""")
def error_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, h = F.col("reference"), F.col("prediction")
    names = {"c1": errors.punctuation_only, "c2": errors.number_mismatch, "c3": errors.loan_script, "c4": errors.homophone, "c5": errors.repetition, "c6": errors.deletion, "c7": errors.insertion}
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", *[f(r, h).alias(k) for k, f in names.items()])


@query("""
WITH top AS (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM (SELECT * FROM events WHERE value > 0 ORDER BY value DESC, event_id LIMIT 100)),
s AS (SELECT greatest(1, max(rank) // 25) AS step FROM top)
SELECT event_id, value, rank::INT AS rank, ((rank - 1) // step)::INT AS sample_rank FROM top, s WHERE (rank - 1) % step = 0 AND (rank - 1) // step < 25""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.sample_errors(read(spark, sf_dir, "events").select("event_id", "value"), wer="value", key="event_id")


@query("""
WITH c AS (SELECT event_type AS category, count(*) AS n, min(event_id) AS first_order FROM events GROUP BY 1),
e AS (SELECT event_type AS category, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
SELECT category, n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS first_ids FROM c JOIN e USING (category) WHERE rn <= 5 GROUP BY category, n""")
def taxonomy_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    labelled = e.select(F.col("event_type").alias("category"), F.col("event_id").alias("order"), F.col("event_id").cast("string").alias("reference"), F.lit("").alias("prediction"), F.col("value").alias("wer"))
    return taxonomy.taxonomy(labelled).select("category", "n", F.array_join(F.transform("examples", lambda x: x.reference), ",").alias("first_ids"))


@query("""
SELECT e.user_id AS recording_id, e.user_id || '_audio.wav' AS audio_path, 0.0::DOUBLE AS start, e.value AS "end", e.value AS duration, e.event_type AS text, e.event_id AS speaker_id
FROM events e WHERE trim(e.event_type) <> '' AND e.value BETWEEN 0.5 AND 30.0""")
def segment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a recording of one segment, written as JSON and parsed again."""
    e = read(spark, sf_dir, "events")
    row = F.struct(F.lit(0.0).alias("start"), F.col("value").alias("end"), F.col("event_id").alias("speaker_id"), F.col("event_type").alias("text"))
    spoken = e.select(F.col("event_id").alias("recording_id"), "user_id", F.concat(F.col("user_id").cast("string"), F.lit("_audio.wav")).alias("audio_path"))
    json = e.select(F.col("event_id").alias("recording_id"), F.to_json(F.array(row)).alias("json"))
    out = manifest.build_manifest(spoken, json)
    return out.withColumn("recording_id", F.regexp_extract("audio_path", "^([0-9]+)_", 1).cast("long"))


@query("""
SELECT count(*) AS n_segments, round(sum(value) / 3600, 6) AS hours, count(DISTINCT user_id) AS n_recordings, count(DISTINCT event_type) AS n_speakers, round(avg(value), 6) AS mean,
  round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std FROM events""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.corpus_stats(read(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("hours", "mean", "median", "std")})


@query("""
SELECT count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25,
  quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem""")
def describe_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.describe_duration(read(spark, sf_dir, "lineitem"), "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT count(*) AS recordings, count(DISTINCT user_id) AS users, round(sum(value) / 3600, 6) AS hours FROM events")
def metadata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.metadata_summary(read(spark, sf_dir, "events").withColumnRenamed("value", "duration")).withColumn("hours", F.round("hours", 6))


@query("SELECT page_id, replace(url, 'http', 'store') AS url FROM pages")
def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.rewrite_urls(read(spark, sf_dir, "pages").select("page_id", "url"), "http", "store")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[^\x{0900}-\x{097F}\sa-zA-Z0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len({SPLIT.format(c='text')})::BIGINT AS words FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("words"))


@query("SELECT o_orderkey AS n, o_orderkey::VARCHAR AS digits FROM orders WHERE o_orderkey < 1000000000")
def number_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys spelled in Hindi and normalised back to digits; the SQL knows nothing of either."""
    said = read(spark, sf_dir, "orders").where("o_orderkey < 1000000000").select(F.col("o_orderkey").alias("n"), numbers.spell_number(F.col("o_orderkey")).alias("said"))
    return said.select("n", numbers.normalize_numbers(F.col("said")).alias("digits"))


@query("SELECT p_partkey AS n, 'मेरी उम्र ' || p_size || ' साल है, एक साथ' AS said FROM part")
def number_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("मेरी उम्र "), numbers.spell_number(F.col("p_size")), F.lit(" साल है, एक साथ"))
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("n"), numbers.normalize_numbers(line).alias("said"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 5000 ORDER BY md5('42:' || c_custkey::VARCHAR), c_custkey LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_op.seeded_sample(read(spark, sf_dir, "customer").where("c_acctbal < 5000").select("c_custkey", "c_name"), "c_custkey", 50)


@query("""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey) <= ceil(count(*) OVER () * 10 / 100) THEN 'eval' ELSE 'train' END AS split FROM orders""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.exact_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""
WITH l AS (SELECT p_partkey, p_partkey // 4 AS batch, list_transform(range(0, p_size % 7 + 1), lambda i: CASE WHEN i = 0 THEN 1 ELSE p_size + i END) AS x FROM part),
m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch) AS n FROM l)
SELECT p_partkey, batch, array_to_string(list_concat(x, list_transform(range(0, n - len(x)), lambda i: -100))[2:], ',') AS labels FROM m""")
def label_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(0), F.col("p_size") % 7), lambda i: F.when(i == 0, 1).otherwise(F.col("p_size") + i).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey"), ids.alias("labels"))
    out = manifest.collate_labels(rows, "p_partkey", bos=1)
    return out.select("p_partkey", "batch", F.array_join("labels", ",").alias("labels"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "page string").page.alias("page"))
