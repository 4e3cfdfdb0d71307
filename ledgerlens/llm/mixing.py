"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain > language > source; a leaf is one (domain, language, source).
Weights are integers on each level; a child's share of its parent's budget is its
weight over the sum of its siblings'. A node can take at most its capacity: its
tokens times ``MAX_EPOCHS``. What it cannot take goes to its siblings in
proportion to their weights, and only what all of them cannot take goes up, to the
parent's siblings. Level by level that is one closed form: siblings sorted by
capacity over weight, the first ones full, the others sharing the rest (running
sums over siblings; nothing iterates).

A leaf of budget b and t tokens takes ``b // t`` whole epochs and of the next one
a prefix: its documents in an order seeded by epoch and id, until the budget is
reached (the document that reaches it included). Running sums over a large leaf
go in two steps, over 4,096 ranges of the seeded order and within one range, so
no leaf is ever in one task.

All numbers are integers, so budgets are exact. Tokens are runs of characters
other than ASCII white space, over whole texts.

Defined cases: a null language or source is a leaf named "unknown"; a null text or
one without tokens has no tokens and is never taken; ties in the seeded order
(repeated rows) go by text; a null id is ordered as the empty string; an empty
table gives an empty table; other columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, table

SEED = 20240601
#: Tokens of the mixture, per cent of all tokens.
BUDGET_PERCENT = 60
MAX_EPOCHS = 2

# The domain of a source, and target weights. A name that is not listed has OTHER's weight.
DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"),
           "books": ("src8", "src9", "src10", "src11"),
           "code": ("src12", "src13"),
           "news": ("src14", "src15", "src16", "src17", "src18", "src19")}
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "code": 10, "news": 15}
LANG_WEIGHTS = {"en": 55, "de": 20, "fr": 15, "es": 10}
SOURCE_WEIGHTS = {"src0": 3}
OTHER = {"domain": 5, "lang": 5, "source": 1}
LEVELS = ("domain", "lang", "source")
TOKEN = "[^\\x20\\x09-\\x0D]+"


def _named(column: Column, values: dict[str, int | str], other) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def leaves_of(docs: DataFrame) -> DataFrame:
    """Adds domain, leaf_lang, leaf_source and n_tokens."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    domain = _named(source, {s: d for d, all_of in DOMAINS.items() for s in all_of}, "other")
    return (docs.withColumn("domain", domain).withColumn("leaf_lang", F.coalesce(F.col("lang"), F.lit("unknown")))
            .withColumn("leaf_source", source)
            .withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")))


def _share(nodes: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """Shares column ``given`` of each parent among its children (columns n_tokens, capacity)
    as column ``budget``, none above its capacity."""
    big = "decimal(38,0)"
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    names = [c for c in ("domain", "leaf_lang", "leaf_source") if c in nodes.columns]
    order = siblings.orderBy(F.col("capacity").cast("double") / F.col("weight"), *names)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = (nodes.withColumn("weight", weight.cast("long"))
             .withColumn("full_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(big))
             .withColumn("weight_left", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    left = F.col("given") - F.col("full_before")
    # full if its capacity is no more than its part of what the ones before left over
    is_full = F.col("capacity").cast(big) * F.col("weight_left") <= left * F.col("weight")
    nodes = nodes.withColumn("is_full", is_full)
    full_sum = F.sum(F.when(F.col("is_full"), F.col("capacity")).otherwise(0)).over(siblings)
    open_weight = F.sum(F.when(F.col("is_full"), F.lit(0)).otherwise(F.col("weight"))).over(siblings)
    part = F.expr("cast((given - full_sum) * weight as decimal(38,0)) div open_weight")
    return (nodes.withColumn("full_sum", full_sum).withColumn("open_weight", open_weight)
            .withColumn("budget", F.when(F.col("is_full"), F.col("capacity")).otherwise(part).cast("long"))
            .drop("full_before", "weight_left", "is_full", "full_sum", "open_weight", "weight", "given"))


def budgets(leaves: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, leaf_lang, leaf_source, n_tokens, budget) of every leaf with tokens."""
    names = ["domain", "leaf_lang", "leaf_source"]
    leaf = leaves.where("n_tokens > 0").withColumn("capacity", F.col("n_tokens") * max_epochs)
    domains = (leaf.groupBy("domain").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("capacity").alias("capacity"))
               .withColumn("given", F.expr(f"sum(n_tokens) over () * {budget_percent} div 100")))
    shared = _share(domains, [], _named(F.col("domain"), DOMAIN_WEIGHTS, OTHER["domain"]))
    for depth, (name, weights) in enumerate((("leaf_lang", LANG_WEIGHTS), ("leaf_source", SOURCE_WEIGHTS)), 1):
        parent, own = names[:depth], names[:depth + 1]
        given = shared.select(*parent, F.col("budget").alias("given"))
        nodes = leaf.groupBy(*own).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("capacity").alias("capacity"))
        shared = _share(nodes.join(given, parent), parent, _named(F.col(name), weights, OTHER[LEVELS[depth]]))
    return shared.select(*names, "n_tokens", "budget")


def _place(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"),
                          F.coalesce(doc_id.cast("string"), F.lit(""))))


def _copies(sized: DataFrame, seed: int, budget_percent: int, max_epochs: int) -> DataFrame:
    """Rows of ``sized`` (doc_id, names of the leaf, n_tokens, text_key, anything else) that are
    taken, with the number of copies."""
    names = ["domain", "leaf_lang", "leaf_source"]
    # leaves are few: as many as distinct (language, source)
    leaf = budgets(sized.groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens")), budget_percent, max_epochs)
    leaf = cut(leaf.select(*names, F.expr("budget div n_tokens").alias("whole"), F.expr("budget % n_tokens").alias("rest")), "leaves")
    spread = (sized.join(leaf, names)
              .withColumn("place", _place(F.col("whole"), F.col("doc_id"), seed))
              .withColumn("part", F.substring("place", 1, 3)))
    parts = spread.groupBy(*names, "part").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*names, "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    within = (Window.partitionBy(*names, "part").orderBy("place", "doc_id", "text_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = spread.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    copies = F.col("whole") + F.when(F.col("ahead") + F.col("inside") < F.col("rest"), 1).otherwise(0)
    return inside.join(parts, [*names, "part"]).withColumn("copies", copies.cast("int")).where("copies > 0")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    placed = leaves_of(docs.select("doc_id", "text", "lang", "source", *more))
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), "domain", "leaf_lang", "leaf_source", "n_tokens",
                         F.md5("text").alias("text_key"), *[c for c in placed.columns if c == "row"]).where("n_tokens > 0")


def mixture(docs: DataFrame, seed: int = SEED, budget_percent: int = BUDGET_PERCENT,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, domain, leaf_lang, leaf_source, n_tokens, copies): how often each document is taken."""
    return _copies(cut(_sized(docs), "sized"), seed, budget_percent, max_epochs).select(
        "doc_id", "domain", "leaf_lang", "leaf_source", "n_tokens", "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED, budget_percent: int = BUDGET_PERCENT,
                    max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, one for each epoch that takes them."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    taken = _copies(_sized(docs, row), seed, budget_percent, max_epochs)
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), "n_tokens", "copies")


def _sql_case(column: str, values: dict, other) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in values.items()) + f" ELSE {text(other)} END"


def mixing_sql(documents: str = "documents") -> str:
    """The same mixture in DuckDB SQL: budgets level by level, then one running sum a leaf."""
    domain = _sql_case("coalesce(source, 'unknown')", {s: d for d, all_of in DOMAINS.items() for s in all_of}, "other")

    def level(name: str, nodes: str, keys: str, parent: str, weight: str) -> str:
        over = f"PARTITION BY {parent}"
        return f"""
{name}_w AS (SELECT *, {weight} AS weight FROM ({nodes})),
{name}_s AS (SELECT *, coalesce(sum(capacity) OVER before, 0) AS full_before,
    sum(weight) OVER ({over}) - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM {name}_w WINDOW before AS ({over} ORDER BY CAST(capacity AS DOUBLE) / weight, {keys}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT *, capacity::HUGEINT * weight_left <= (given - full_before)::HUGEINT * weight AS is_full FROM {name}_s),
{name} AS (SELECT {keys}, n_tokens, CASE WHEN is_full THEN capacity ELSE
    (given - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}))::HUGEINT * weight
    // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}) END AS budget FROM {name}_f)"""

    group = "sum(n_tokens) AS n_tokens, sum(n_tokens) * {} AS capacity".format(MAX_EPOCHS)
    return f"""
WITH sized AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens, md5(text) AS text_key
  FROM {documents}
), kept AS (SELECT * FROM sized WHERE n_tokens > 0),{level(
    "d", f"SELECT domain, {group}, (SELECT sum(n_tokens) FROM kept) * {BUDGET_PERCENT} // 100 AS given FROM kept GROUP BY domain",
    "domain", "1", _sql_case("domain", DOMAIN_WEIGHTS, OTHER["domain"]))},{level(
    "l", f"SELECT k.domain, k.lang, any_value(d.budget) AS given, sum(k.n_tokens) AS n_tokens, sum(k.n_tokens) * {MAX_EPOCHS} AS capacity "
    "FROM kept k JOIN d USING (domain) GROUP BY k.domain, k.lang", "domain, lang", "domain",
    _sql_case("lang", LANG_WEIGHTS, OTHER["lang"]))},{level(
    "s", f"SELECT k.domain, k.lang, k.source, any_value(l.budget) AS given, sum(k.n_tokens) AS n_tokens, "
    f"sum(k.n_tokens) * {MAX_EPOCHS} AS capacity FROM kept k JOIN l USING (domain, lang) GROUP BY k.domain, k.lang, k.source",
    "domain, lang, source", "domain, lang", _sql_case("source", SOURCE_WEIGHTS, OTHER["source"]))},
ranked AS (
  SELECT k.*, s.budget // s.n_tokens AS whole, s.budget % s.n_tokens AS rest,
    coalesce(sum(k.n_tokens) OVER (PARTITION BY k.domain, k.lang, k.source
      ORDER BY md5(concat('{SEED}:', s.budget // s.n_tokens, ':', coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id, text_key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM kept k JOIN s USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM ranked WHERE whole > 0 OR ahead < rest
"""


OP4_SQL = mixing_sql()
