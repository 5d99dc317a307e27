"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are counted into cells of all dimensions (source, language, topic). Sweeps of proportional fitting rake the
cells' weights until each dimension's token shares meet their targets; then every document is sampled by its cell's
probability. The corpus is read once for the counts and once for the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused

#: Cells up to which their probabilities are broadcast: some MB.
MOST_BROADCAST = 50_000

#: Stand-in for a topic column: bands of document length in words.
TOPICS = {"brief": 0.2, "medium": 0.5, "long": 0.3}
LANGUAGES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def length_topic(tokens: Column) -> Column:
    return F.when(tokens < 150, "brief").when(tokens < 600, "medium").otherwise("long")


def unit(doc_id: Column) -> Column:
    """A number from 0 to 1 (excluded) that depends on the id alone; null for a null id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), doc_id.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def _shares(cells: DataFrame, targets: dict[str, dict[str, float] | None]) -> dict[str, Column]:
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    shares = {}
    for dimension, target in targets.items():
        value = F.coalesce(F.col(dimension).cast("string"), F.lit(""))
        named = F.lit(1.0) if target is None else F.coalesce(*(F.when(value == k, F.lit(float(v))) for k, v in target.items()))
        own = cells.where("tokens > 0").groupBy(dimension).agg(F.sum("tokens").alias("tokens")).agg(F.sum(named), F.sum(F.when(named.isNull(), F.col("tokens")))).first()
        if total and target is not None and own[0] is None:
            raise ValueError(f"no value of {dimension} has a target: {sorted(target)}")
        left = 1.0 - (own[1] or 0) / total if total else 1.0
        kept = F.sum("tokens").over(Window.partitionBy(dimension)) / F.lit(float(total or 1))
        shares[dimension] = F.coalesce(named / F.lit(float(own[0] or 1.0)) * F.lit(left), kept)
    return shares


def largest_error(cells: DataFrame, targets: dict[str, dict[str, float] | None]) -> float:
    """cells(dimensions..., tokens, weight) -> the largest gap between a value's share of weighted tokens and its target."""
    weighted = F.col("weight") * F.col("tokens")
    total = cells.agg(F.sum(weighted)).first()[0]
    if not total:
        return 0.0
    gaps = [F.max(F.abs(F.col(f"p{i}") / F.lit(float(total)) - F.col(f"s{i}"))) for i in range(len(targets))]
    parts = [x for i, (d, share) in enumerate(_shares(cells, targets).items()) for x in (F.sum(weighted).over(Window.partitionBy(d)).alias(f"p{i}"), share.alias(f"s{i}"))]
    return max(cells.where("tokens > 0").select("tokens", "weight", *targets, *parts).agg(*gaps).first())


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | None], sweeps: int = 12, tolerance: float = 0.0) -> DataFrame:
    """cells(dimensions..., tokens) -> the same with weight: sweeps of proportional fitting, one dimension after another,
    `sweeps` at most; every third one stops if largest_error() is under the tolerance.

    A dimension's target maps its values to shares; None means equal shares for the values that occur. Values without a
    target keep the share of tokens that they have, and the named ones share the rest; targets of values that do not
    occur are left out and the others grow in proportion, but targets of which no value occurs are refused with a
    ValueError. Null is a value of its own, named "" in a target.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    shares = _shares(cells, targets)
    for sweep in range(sweeps):
        for dimension, share in shares.items():
            part = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(dimension))
            out = out.withColumn("weight", F.when(part > 0, F.col("weight") * share * F.lit(float(total)) / part).otherwise(F.lit(0.0)))
        if sweep % 3 == 2:
            out = cut(out)
            if tolerance and largest_error(out, targets) < tolerance:
                break
    return out.select(cells.columns + ["weight"])


def mix(docs: DataFrame, targets: dict[str, dict[str, float] | None], topic: Column | None = None, sweeps: int = 12, rate: float = 0.5) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) -> the columns of docs with n_tokens, topic, weight, probability, residual and
    sampled; a column of docs that has one of these names gives way to it, but for a topic, which is used.

    targets: see rake(); its keys are columns of docs or "topic". A topic is the argument of that name, else the column
    topic of docs, else a band of length. residual is what raking left: the largest gap between any value's share of
    weighted tokens and its target, the same in every row. A document's
    weight is that of its cell, on average 1 over all tokens; probability is rate * weight, 1 at most, so the sample
    has about `rate` of all tokens however rare a cell is, and where a cell is too rare for its share weight /
    probability is the importance that its documents keep. sampled holds if a hash of doc_id falls below probability,
    so the choice is the same in every run. Null and empty texts have no tokens and add nothing to a share. A null
    doc_id is never sampled. Rows that share a doc_id are sampled alike. An empty table gives no row.
    """
    tokens = n_tokens(F.col("text").cast("string"))
    counted = docs.withColumn("n_tokens", tokens)
    if topic is not None or "topic" not in (c.lower() for c in docs.columns):
        counted = counted.withColumn("topic", length_topic(F.col("n_tokens")) if topic is None else topic)
    counted = counted.drop("weight", "probability", "residual", "sampled")
    dimensions = list(targets)
    cells = cut(counted.groupBy(*dimensions).agg(F.sum("n_tokens").alias("tokens")))
    raked = cut(rake(cells, targets, sweeps))
    of = {name: unused(name, counted) for name in [*(f"of_{d}" for d in dimensions), "of_weight"]}
    of_cell = raked.select(*(F.col(d).alias(of[f"of_{d}"]) for d in dimensions), F.col("weight").alias(of["of_weight"]))
    same = [F.col(d).eqNullSafe(F.col(of[f"of_{d}"])) for d in dimensions]
    joined = counted.join(F.broadcast(of_cell) if of_cell.count() <= MOST_BROADCAST else of_cell, same, "left")
    out = joined.withColumn("weight", F.col(of["of_weight"])).withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("weight")))
    out = out.withColumn("residual", F.lit(float(largest_error(raked, targets))))
    out = out.withColumn("sampled", F.coalesce(unit(F.col("doc_id")) < F.col("probability"), F.lit(False)))
    return out.drop(*of.values())
