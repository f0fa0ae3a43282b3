"""Operator 4: temperature mixing of sources under a token budget.

Weights are the sources' token shares to the power of an exponent, normalised. The exponent is the
smallest that keeps every source within the repetition limit, or that brings the entropy down to the
target; it is searched by sixteen-way bisection on one aggregate a step. Each source's quota becomes
whole epochs and a rest; the rest takes blocks of documents in an order that a hash permutes anew each
epoch, and from the first block that doesn't fit whole, documents in hash order while they fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.frames import cut

WAYS, SCALE = 16, 1_000_000


def tokens(text_column: str) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(r"[^\x09-\x0D\x20]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, budget: int, total: int, repetition: float | None, entropy: float | None) -> float:
    """In steps of a millionth, the smallest exponent from 0 to 1 that meets the limit, else 1. sources: (_t) tokens, positive."""
    share = F.col("_t") / F.lit(total)

    def met(points: list[float]) -> list[bool]:
        own = [F.sum(F.pow(share, F.lit(a))).alias(f"z{k}") for k, a in enumerate(points)]
        own += [F.max(F.pow(share, F.lit(a)) / F.col("_t")).alias(f"m{k}") for k, a in enumerate(points)]
        own += [F.sum(F.pow(share, F.lit(a)) * F.log(share) * a).alias(f"e{k}") for k, a in enumerate(points)]
        r = sources.agg(*own).first()
        within = lambda k: r[f"m{k}"] / r[f"z{k}"] * budget <= repetition * (1 + 1e-12)
        spread = lambda k: math.log(r[f"z{k}"]) - r[f"e{k}"] / r[f"z{k}"] <= entropy + 1e-12
        return [(repetition is None or within(k)) and (entropy is None or spread(k)) for k in range(len(points))]

    low, high = -1, SCALE
    while high - low > 1:
        points = sorted({min(high - 1, low + max(1, (high - low) * k // WAYS)) for k in range(1, WAYS)} | ({0} if low < 0 else set()))
        for point, ok in zip(points, met([p / SCALE for p in points]), strict=True):
            if ok:
                high = point
                break
            low = point
    return high / SCALE


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", budget: int | None = None, repetition: float | None = 1.25, entropy: float | None = None, block_tokens: int = 1_000_000) -> DataFrame:
    """docs as the mixture wants them, each with n_tokens, epoch and block; columns of these names are replaced.

    budget is in tokens (None: as many as docs have); it is lowered to repetition * tokens where it asks for
    more. A null source is a source. Texts without tokens cost nothing and come in whole epochs and in blocks
    taken whole; a source without any tokens comes once. A source's tokens never exceed its quota. Equal
    hashes fall in order of id, then text. Columns may have any name.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block")]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    id_, text = (F.col(f"row.{quoted(c)}") for c in (id_column, text_column))
    key = F.coalesce(F.concat(F.lit("="), F.col(quoted(source_column)).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"), key.alias("s"), tokens(quoted(text_column)).alias("n_tokens"))
    all_sources = cut(rows.groupBy("s").agg(F.sum("n_tokens").alias("_t")))
    sized = all_sources.where("_t > 0")
    total = sized.agg(F.sum("_t")).first()[0]
    if not total:
        return rows.select("row.*", "n_tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"))
    budget = total if budget is None else budget
    if repetition is not None:
        budget = min(budget, int(repetition * total))
    a = exponent(sized, budget, total, repetition, entropy)
    z = sized.agg(F.sum(F.pow(F.col("_t") / F.lit(total), F.lit(a)))).first()[0]
    quota = F.floor(F.round(F.pow(F.col("_t") / F.lit(total), F.lit(a)) / F.lit(z) * budget, 3)).cast("long")
    plan = sized.select("s", quota.alias("q"), "_t", F.ceil(F.col("_t") / block_tokens).cast("long").alias("blocks"))
    plan = plan.select("s", F.floor(F.col("q") / F.col("_t")).cast("int").alias("epochs"), (F.col("q") % F.col("_t")).alias("rest"), "blocks")
    bare = all_sources.where("_t = 0").select("s", F.lit(1).alias("epochs"), F.lit(0).cast("long").alias("rest"), F.lit(1).cast("long").alias("blocks"))
    plan = cut(plan.unionAll(bare))
    digits = F.conv(F.substring(F.md5(F.concat(F.col("s"), F.lit("/"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    few = plan.count() <= 100_000
    rows = rows.join(F.broadcast(plan) if few else plan, "s").withColumn("h", digits).withColumn("block", F.pmod("h", F.col("blocks")))
    whole = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    taken = rows.where("rest > 0").join(cut(_until(rows)), ["s", "block"]).withColumn("epoch", F.col("epochs"))
    fits = F.sum("n_tokens").over(Window.partitionBy("s", "block").orderBy("h", id_, text).rowsBetween(Window.unboundedPreceding, 0))
    edge = taken.where("not full").withColumn("upto", fits).where("upto <= left")
    out = ["row.*", "n_tokens", "epoch", "block"]
    return whole.select(*out).unionAll(taken.where("full").select(*out)).unionAll(edge.select(*out))


def _until(rows: DataFrame) -> DataFrame:
    """(s, block, left, full): the blocks that a source's rest of tokens takes, in hashed order, what is left for each, and whether it fits whole.

    Sums run in two levels, over the hash's first three digits and then within them, so that no source's
    blocks are in one task.
    """
    order = F.md5(F.concat_ws("/", "s", F.col("epochs").cast("string"), F.col("block").cast("string")))
    blocks = rows.where("rest > 0").groupBy("s", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("b"))
    blocks = cut(blocks.withColumn("o", order).withColumn("lead", F.substring("o", 1, 3)))
    before = Window.partitionBy("s").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    leads = blocks.groupBy("s", "lead").agg(F.sum("b").alias("n")).select("s", "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("gone"))
    upto = F.sum("b").over(Window.partitionBy("s", "lead").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1))
    left = blocks.join(leads, ["s", "lead"]).withColumn("left", F.col("rest") - F.col("gone") - F.coalesce(upto, F.lit(0)))
    return left.where("left > 0").select("s", "block", "left", (F.col("left") >= F.col("b")).alias("full"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce('=' || source, '') AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')), 0) AS BIGINT) AS n_tokens FROM documents),
  z0 AS (SELECT s, sum(n_tokens)::BIGINT AS t FROM d GROUP BY s), z AS (SELECT * FROM z0 WHERE t > 0), tot AS (SELECT sum(t)::BIGINT AS total FROM z),
  bis(lo, hi) AS (SELECT -1, 1000000 UNION ALL SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM
    (SELECT lo, hi, mid, (SELECT max(pow(t / total::DOUBLE, mid / 1e6) / t) / sum(pow(t / total::DOUBLE, mid / 1e6)) * any_value(total) <= {repetition} * (1 + 1e-12) FROM z, tot) AS ok
     FROM (SELECT lo, hi, CAST(floor((lo + hi) / 2.0) AS INT) AS mid FROM bis WHERE hi - lo > 1))),
  a AS (SELECT min(hi) / 1e6 AS a FROM bis), w AS (SELECT s, t, pow(t / total::DOUBLE, a) AS w, total FROM z, tot, a),
  q AS (SELECT s, t, CAST(floor(round(w / (SELECT sum(w) FROM w) * total, 3)) AS BIGINT) AS q, CAST(ceil(t / {block}.0) AS BIGINT) AS blocks FROM w),
  p AS (SELECT s, q // t AS epochs, q % t AS rest, blocks FROM q UNION ALL SELECT s, 1, 0, 1 FROM z0 WHERE t = 0),
  r AS (SELECT d.*, epochs, rest, blocks, CAST('0x' || substr(md5(d.s || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM d JOIN p ON d.s = p.s),
  rb AS (SELECT *, h % blocks AS block FROM r),
  b AS (SELECT s, block, any_value(rest) - sum(sum(n_tokens)) OVER (PARTITION BY s ORDER BY md5(s || '/' || any_value(epochs) || '/' || block), block ROWS UNBOUNDED PRECEDING) + sum(n_tokens) AS lft, sum(n_tokens) AS b FROM rb WHERE rest > 0 GROUP BY s, block),
  e AS (SELECT rb.doc_id, rb.source, rb.n_tokens, rb.epochs, rb.block, b.lft, b.b, sum(rb.n_tokens) OVER (PARTITION BY rb.s, rb.block ORDER BY rb.h, rb.doc_id, rb.text ROWS UNBOUNDED PRECEDING) AS f FROM rb JOIN b ON rb.s = b.s AND rb.block = b.block WHERE b.lft > 0 AND rb.rest > 0)
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, block FROM (SELECT doc_id, source, n_tokens, unnest(range(0, epochs)) AS epoch, block FROM rb WHERE epochs > 0)
UNION ALL SELECT doc_id, source, n_tokens, CAST(epochs AS INT), block FROM e WHERE lft >= b OR f <= lft"""
