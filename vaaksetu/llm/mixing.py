"""Mixing sources to target weights: hierarchical token budgets and seeded epochs, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, fresh, stage

#: Rows that a bucket of a leaf's order has on average at most; a hex digit of the order's key divides them by 16.
BUCKET_ROWS = 4096
#: A leaf table of more rows than this is joined, not broadcast.
BROADCAST_LEAVES = 20_000


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """A row's place in an epoch of its leaf: the MD5 digest of seed, epoch and id, as hex text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def sized(docs: DataFrame, id_col: str, text_col: str, levels: dict[str, Column]) -> DataFrame:
    """(id, level columns, n_tokens): tokens are words of the whole text; null level values are the node 'none', null texts have no tokens."""
    cols = [F.coalesce(c.cast("string"), F.lit("none")).alias(name) for name, c in levels.items()]
    return docs.select(F.col(id_col).alias("id"), *cols, F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))


def _weight(path: list[str], weights: dict[str, int]) -> Column:
    """A node's weight by its path 'a/b/c'; nodes that aren't named weigh 1."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, w)])
    return F.coalesce(F.get(F.array(F.element_at(table, F.concat_ws("/", *path))), F.lit(0)), F.lit(1)).cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, int], budget: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (level columns, tokens, rows) with `allocated`: the tokens that each leaf gives.

    The root's budget is budget[0] / budget[1] of all tokens. A node can give at most max_epochs times the
    tokens below it. Level by level a node's budget is shared among its children by weight; a child that
    can't give its share gives all it has and its siblings share the rest by weight. A node's budget never
    exceeds what is below it, so a shortage leaves a family only when the whole family is exhausted, and is
    then taken up by the ancestor's siblings. Shares are whole tokens that sum to the parent's exactly.
    Nodes of weight 0 give nothing. All of this runs on one row for each node.
    """
    dec = lambda c: c.cast("decimal(18,0)")
    live = reduce(lambda a, b: a & b, [_weight(levels[: d + 1], weights) > 0 for d in range(len(levels))])
    at = leaves.where(live).withColumn("cap", F.col("tokens") * max_epochs)
    top = at.agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    given = top.select(F.lit("root").alias("_root"), F.least(F.expr(f"tokens * {budget[0]} div {budget[1]}"), F.col("cap")).alias("budget"))
    at = at.withColumn("_root", F.lit("root"))
    for d, level in enumerate(levels):
        above = ["_root", *levels[:d]]
        nodes = at.groupBy(*above, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(levels[: d + 1], weights)).join(given, above)
        # Ascending cap / weight: those that can't give their share come first.
        turn = W.partitionBy(*above).orderBy(F.col("cap") / F.col("w"), level)
        nodes = nodes.withColumn("w_left", F.sum("w").over(turn.rowsBetween(0, W.unboundedFollowing))).withColumn("b_left", F.col("budget") - F.coalesce(F.sum("cap").over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        nodes = nodes.withColumn("short", dec(F.col("cap")) * dec(F.col("w_left")) <= dec(F.col("w")) * dec(F.col("b_left")))
        family = W.partitionBy(*above)
        rest_b = F.col("budget") - F.coalesce(F.sum(F.when(F.col("short"), F.col("cap"))).over(family), F.lit(0))
        rest_w = F.sum(F.when(~F.col("short"), F.col("w"))).over(family)
        nodes = nodes.withColumn("rest_b", rest_b).withColumn("rest_w", rest_w).withColumn("cum_w", F.sum(F.when(~F.col("short"), F.col("w")).otherwise(0)).over(W.partitionBy(*above).orderBy(level).rowsBetween(W.unboundedPreceding, 0)))
        share = F.expr("cast(rest_b as decimal(18,0)) * cast(cum_w as decimal(18,0)) div rest_w - cast(rest_b as decimal(18,0)) * cast(cum_w - w as decimal(18,0)) div rest_w")
        given = nodes.select(*above, level, F.when(F.col("short"), F.col("cap")).otherwise(share).cast("long").alias("budget"))
    return leaves.join(given.drop("_root").withColumnRenamed("budget", "allocated"), levels, "left").withColumn("allocated", F.coalesce("allocated", F.lit(0).cast("long")))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, int], budget: tuple[int, int] = (1, 2), max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, levels, n_tokens, full_epochs, prefix_tokens, used_tokens.

    A leaf that must give a tokens of its t gives a div t whole epochs and, of the next epoch, the first
    a mod t tokens in that epoch's seeded order: documents at its front whole, one in part.
    A leaf's order is never sorted in one task: rows are summed by the leading digits of their order key,
    the running sums of those buckets show in which one the prefix ends, and only that bucket's rows, some thousands
    at any size of the leaf, are put in order. Rows that agree in id and tokens are interchangeable. Null texts use nothing.
    """
    if {"id", "n_tokens", "full_epochs", "prefix_tokens", "used_tokens"} & set(levels):
        raise ValueError("a level has the name of a column of the result")
    # Levels have names of their own within, so that a caller's names can't clash with what is computed here.
    names = [f"_level{i}" for i in range(len(levels))]
    rows = stage(sized(docs, id_col, text_col, dict(zip(names, levels.values()))), "sized")
    leaves = stage(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    plan = budgets(leaves, names, weights, budget, max_epochs)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.expr("allocated div tokens")).otherwise(0)).withColumn("rest", F.col("allocated") - F.col("full") * F.col("tokens"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest(F.col("rows"), F.lit(1)) / BUCKET_ROWS))).cast("int")
    plan = stage(plan.select(*names, "full", "rest", digits.alias("digits")), "plan")
    small = plan.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)
    keyed = rows.join(hint(plan), names).withColumn("_key", order_key(seed, F.col("full"), F.col("id"))).withColumn("_bucket", F.substring("_key", F.lit(1), F.col("digits")))
    sums = keyed.groupBy(*names, "_bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy(*names).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ends = sums.withColumn("before", before).where("before < rest and before + n >= rest").select(*names, F.col("_bucket").alias("_last"), "before")
    keyed = keyed.join(hint(ends), names, "left")
    whole = keyed.where("_last is null or _bucket <> _last").withColumn("prefix_tokens", F.when(F.col("_bucket") < F.col("_last"), F.col("n_tokens")).otherwise(0))
    order = W.partitionBy(*names).orderBy("_key", "id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")
    edge = keyed.where("_bucket = _last").withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - upto)))
    out = ["id", *[F.col(n).alias(level) for n, level in zip(names, levels)], "n_tokens", F.col("full").cast("long").alias("full_epochs"), F.col("prefix_tokens").cast("long").alias("prefix_tokens"), (F.col("full") * F.col("n_tokens") + F.col("prefix_tokens")).cast("long").alias("used_tokens")]
    return whole.select(*out).unionByName(edge.select(*out))


def mix_documents(docs: DataFrame, levels: dict[str, Column], weights: dict[str, int], budget: tuple[int, int], seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of docs that a mixture of one epoch at most uses, with the columns of docs; each leaf's prefix is rounded up to whole documents.

    Documents are matched by id: rows that share an id are kept if one of them is used, and a null id stands for one id. Documents without tokens, null and empty texts among them, are kept, as they cost nothing; an empty table gives an empty one.
    """
    name = fresh("_used", docs)
    used = mix(docs, levels, weights, budget, 1, seed, id_col, text_col).where("used_tokens > 0 or n_tokens = 0").select(F.col("id").alias(name)).distinct()
    return docs.join(used, docs[id_col].eqNullSafe(F.col(name)), "left_semi")


#: Domains of the driver's sources: the number in a source's name, modulo 3.
DOMAIN_SQL = "CASE CAST(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) AS {int}) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'forum' WHEN 2 THEN 'books' ELSE 'none' END"
WEIGHTS = {"web": 3, "forum": 2, "books": 5, "web/en": 4, "books/en": 2, "books/de": 3, "forum/fr": 3, "web/en/src0": 2}
BUDGET, MAX_EPOCHS, SEED = (7, 10), 4, 17


def driver_levels() -> dict[str, Column]:
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)", 1).try_cast("bigint") % 3
    domain = F.when(number == 0, "web").when(number == 1, "forum").when(number == 2, "books").otherwise("none")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def oracle_sql() -> str:
    """DuckDB SQL for mix() over documents; its prefix sums run over whole leaves."""
    levels = ["domain", "lang", "source"]
    weight = lambda d: "CASE " + " || '/' || ".join(levels[: d + 1]) + " " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in sorted(WEIGHTS.items())) + " ELSE 1 END"
    steps = []
    for d, level in enumerate(levels):
        above = ["root", *levels[:d]]
        keys, on = ", ".join(above), f"PARTITION BY {', '.join(above)}"
        steps.append(f"""
    n{d} AS (SELECT *, {weight(d)} AS w FROM (SELECT {keys}, {level}, sum(cap) AS cap FROM caps GROUP BY ALL) JOIN g{d} USING ({keys})),
    o{d} AS (SELECT *, sum(w) OVER ({on} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
      budget - coalesce(sum(cap) OVER ({on} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left FROM n{d}),
    s{d} AS (SELECT *, cap::HUGEINT * w_left <= w::HUGEINT * b_left AS short FROM o{d}),
    r{d} AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE short) OVER ({on}), 0) AS rest_b, sum(w) FILTER (WHERE NOT short) OVER ({on}) AS rest_w,
      sum(CASE WHEN short THEN 0 ELSE w END) OVER ({on} ORDER BY {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_w FROM s{d}),
    g{d + 1} AS (SELECT {keys}, {level}, CASE WHEN short THEN cap ELSE rest_b::HUGEINT * cum_w // rest_w - rest_b::HUGEINT * (cum_w - w) // rest_w END AS budget FROM r{d}),""")
    return f"""
    WITH t AS (SELECT doc_id AS id, {DOMAIN_SQL.format(int="BIGINT").replace("CAST(", "TRY_CAST(")} AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
    caps AS (SELECT 'root' AS root, *, tokens * {MAX_EPOCHS} AS cap FROM leaf),
    g0 AS (SELECT 'root' AS root, least(sum(tokens) * {BUDGET[0]} // {BUDGET[1]}, sum(cap)) AS budget FROM caps),{"".join(steps)}
    plan AS (SELECT domain, lang, source, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS f, CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest
      FROM leaf JOIN g{len(levels)} USING (domain, lang, source)),
    o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || f || ':' || coalesce(id::VARCHAR, '')), id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS upto
      FROM t JOIN plan USING (domain, lang, source))
    SELECT id AS doc_id, domain, lang, source, n_tokens, f::BIGINT AS full_epochs, greatest(0, least(n_tokens, rest - upto))::BIGINT AS prefix_tokens,
      (f * n_tokens + greatest(0, least(n_tokens, rest - upto)))::BIGINT AS used_tokens FROM o"""
