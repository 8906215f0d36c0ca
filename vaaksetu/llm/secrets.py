"""Secret scans with multipart credential linking, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

#: Kinds of span in the order in which spans at one place are listed: the three base kinds, then the weak ones.
#: A kind: its pattern, the group whose length counts (0: the whole match), the least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of hexadecimal digits are maximal, so asking for the least length in the pattern finds the same ones.
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "ident": (r"""(?i)(?:user_?name|login|account_?id|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""", 1, 3),
    "weak": (r"""(?i)(?:passphrase|passcode|pwd|credential|private_?key|secret_?(?:access_?)?key|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 4),
    "endpoint": (r"""(?i)(?:(?:https?|postgres|mysql|mongodb|redis|ftp|ssh)://[A-Za-z0-9._~:@/?&=%-]+|(?:host|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+)""", 0, 8),
}
BASE = ("assign", "access", "hex")
WEAK = ("ident", "weak", "endpoint")
#: The part of a credential that a kind stands for.
PART = {"assign": "secret", "hex": "secret", "access": "id", "ident": "id", "weak": "secret", "endpoint": "endpoint"}
#: Code points between a weak candidate and the complementary part that confirms it: its scope.
SCOPE = 160
ORDER = {k: i for i, k in enumerate(KINDS)}
SPAN = "array<struct<start:int,k:int,end:int>>"


def kind_spans(text: Column, kind: str) -> Column:
    """Spans (start, k, end) of a kind, leftmost and non-overlapping, in code points, end exclusive.

    The text between matches and the matches themselves alternate, so a match starts at the sum of
    the lengths before it. Matches that are too short are dropped after matching, as they still hide
    what they overlap.
    """
    pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    found, sized = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len")))
    steps = F.filter(F.zip_with(steps, sized, lambda s, m: F.struct(s.gap.alias("gap"), s.len.alias("len"), F.length(m).alias("size"))), lambda s: s.len.isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    walked = F.aggregate(
        steps, start,
        lambda acc, s: F.struct(
            (acc.at + s.gap + s.len).alias("at"),
            F.when(s["size"] >= least, F.concat(acc.out, F.array(F.struct((acc.at + s.gap).alias("start"), F.lit(ORDER[kind]).alias("k"), (acc.at + s.gap + s.len).alias("end"))))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: acc.out,
    )
    return F.when(F.rlike(text, p), walked).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, weak): spans of the base kinds, and candidates of the weak kinds, of every whole text.

    key is a digest of id and text: rows that agree in both have the same spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text))
    spans = lambda kinds: F.concat(*[kind_spans(text, k) for k in kinds])
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), F.array_sort(spans(BASE)).alias("base"), spans(WEAK).alias("weak"))


def _part(k: Column) -> Column:
    """Whether a kind is a secret, the others being what a secret goes with."""
    return k.isin([ORDER[x] for x, part in PART.items() if part == "secret"])


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(id, key, base, spans): base spans and those weak candidates that a complementary part confirms.

    A weak secret counts only within `scope` code points of an identifier or an endpoint, and a weak
    identifier or endpoint only within that distance of a secret, weak or not. The interval join runs on
    (key, cell), a cell being `scope` code points: a span lies in the cells that it covers and looks in those
    next to them too, so texts with very many candidates are spread by place and no pair is listed (the
    join is a semi-join). Rows without weak candidates never enter the join.
    """
    needs = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    rows = scanned.where(needs).dropDuplicates(["key"]).select("key", "base", F.explode(F.concat(F.transform("base", lambda s: F.struct(s.alias("s"), F.lit(False).alias("w"))), F.transform("weak", lambda s: F.struct(s.alias("s"), F.lit(True).alias("w"))))).alias("c"))
    rows = rows.select("key", "c.w", "c.s.*", _part(F.col("c.s.k")).alias("secret"))
    cell = lambda at: F.floor(at / scope)
    near = rows.where("w").withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope)))).alias("n")
    there = rows.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end"))))).alias("t")
    meets = (F.col("n.key") == F.col("t.key")) & (F.col("n.cell") == F.col("t.cell")) & (F.col("n.secret") != F.col("t.secret")) & (F.col("n.start") <= F.col("t.end") + scope) & (F.col("t.start") <= F.col("n.end") + scope)
    sure = near.join(there, meets, "left_semi").groupBy("key").agg(F.collect_set(F.struct("start", "k", "end")).alias("sure"))
    linked = scanned.where(needs).join(sure, "key", "left").select("id", "key", "base", F.array_sort(F.concat("base", F.coalesce("sure", F.array().cast(SPAN)))).alias("spans"))
    return scanned.where(~needs).select("id", "key", "base", F.col("base").alias("spans")).unionByName(linked)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, key, base, spans) for each row of docs, see link(). Null and empty texts have no spans; null ids pass through.

    Scanning is a projection; its arrays, not the texts, go to the shared folder before they are linked.
    """
    return link(stage(scan(docs, id_col, text_col), "spans"), scope)


def named(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.k), s.start, s.end)), ",")


def count_kind(spans: str | Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.k == ORDER[kind])).cast("long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret and identifier masked (endpoints stay), all columns and rows kept; size_col, if there, follows the new text.

    Texts that match no pattern, nearly all, pass through as they are; only the others are joined with their spans. Null and empty
    texts stay as they are, null ids and repeated rows are kept, each with its own text masked; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = F.lit(False)
    for k in KINDS:
        if PART[k] != "endpoint":
            some = some | F.rlike(text, F.lit(KINDS[k][0]))
    at, other, spans = (fresh(n, docs) for n in ("_key", "_found", "_spans"))
    found = find_secrets(docs.where(some), id_col, text_col).select(F.col("key").alias(other), F.filter("spans", lambda s: s.k != ORDER["endpoint"]).alias(spans)).where(F.size(spans) > 0).dropDuplicates([other])
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text))
    hit = docs.where(some).withColumn(at, key).join(found, F.col(at) == F.col(other), "left")
    body = F.col(text_col)
    masked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(s.start >= acc.at, F.concat(acc.out, F.substring(body, acc.at + 1, s.start - acc.at), F.lit(mask))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: F.concat(acc.out, F.substring(body, acc.at + 1, F.length(body))),
    )
    hit = hit.withColumn(text_col, F.when(F.col(spans).isNull(), body).otherwise(masked))
    if size_col in docs.columns:
        hit = hit.withColumn(size_col, F.when(F.col(spans).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return docs.where(~some).unionByName(hit.select(docs.columns))


def oracle_sql(scope: int = SCOPE) -> str:
    """DuckDB SQL for the query over documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for kind, (pattern, group, least) in KINDS.items():
        p = quoted(pattern)
        parts.append(f"""
      SELECT rid, {ORDER[kind]} AS k, {str(PART[kind] == "secret").lower()} AS secret, {str(kind in WEAK).lower()} AS w, gone + taken AS start, gone + taken + length(m[i]) AS "end"
      FROM (SELECT rid, i, m, g, list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS gone, coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS taken
            FROM (SELECT rid, gaps, m, g, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT rid, string_split_regex(txt, {p}) AS gaps, regexp_extract_all(txt, {p}, 0) AS m, regexp_extract_all(txt, {p}, {group}) AS g FROM t WHERE regexp_matches(txt, {p}))))
      WHERE length(g[i]) >= {least}""")
    names = "[" + ", ".join(map(quoted, KINDS)) + "]"
    return f"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM documents),
    c AS MATERIALIZED ({" UNION ALL ".join(parts)}),
    kept AS (
      SELECT * FROM c WHERE NOT w
      UNION ALL
      SELECT * FROM c n WHERE w AND EXISTS (SELECT 1 FROM c o WHERE o.rid = n.rid AND o.secret <> n.secret AND n.start <= o."end" + {scope} AND o.start <= n."end" + {scope})
    ),
    s AS (
      SELECT rid, string_agg({names}[k + 1] || ':' || start || ':' || "end", ',' ORDER BY start, k, "end") AS spans,
        string_agg({names}[k + 1] || ':' || start || ':' || "end", ',' ORDER BY start, k, "end") FILTER (WHERE k < {len(BASE)}) AS base,
        count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex
      FROM kept GROUP BY rid
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN s USING (rid)"""
