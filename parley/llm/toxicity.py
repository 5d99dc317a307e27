"""Toxicity: class-conditional Kneser-Ney models over characters, compared by length-normalised log-likelihood.

Each class, toxic and ordinary, has its own counts of five-character expressions; below them both share one backoff
model of Kneser-Ney continuation counts. An expression that neither class has seen is thus smoothed alike in both, and
what remains is log p(c | context, toxic) - log p(c | context, ordinary) for each character. Counts are gathered over
all labelled rows that are not held out, by class, and grow with them. The most frequent of their log ratios, in bounded
number, are broadcast; texts ask for the others in a join. A text's log-likelihoods are compared over its whole length and over
its most toxic stretch, both normalised by length; a logistic curve, fitted to rows that no count has seen, turns the
two into a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .shared import cut, held_out, small_batches

ORDER, BITS = 5, 12
DISCOUNT = 0.75
#: Log ratios that are broadcast, at most: 16 bytes each. Texts that need more of them get these by a join.
MOST_ENTRIES = 1_000_000
#: Labels up to which they are sent to the scan of the texts, about 40 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Expressions that a task counts before it passes them on.
HELD = 1_000_000
#: Characters of a stretch.
STRETCH = 24
_MASK = np.int64((1 << BITS) - 1)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-character expressions of several texts, packed into integers, and each text's first one.

    Characters are lower-cased; what is no letter and no digit is a blank, a run of these is one. Each text begins with
    ORDER - 1 blanks, so each of its characters has one expression that ends in it.
    """
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = arrays.lower_points()[points]
    letter = (points >= 128) | ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begins = heads[:-1][heads[:-1] < len(keep)]
    keep[begins] = letter[begins]
    kept = np.concatenate([[0], np.cumsum(keep)])[heads]
    symbols = np.where(letter, 1 + points.astype(np.int64) % int(_MASK), 0)[keep]
    # ORDER - 1 blanks before each text.
    n = len(offsets) - 1
    lengths = np.diff(kept)
    padded = np.zeros(len(symbols) + (ORDER - 1) * n, np.int64)
    first = kept[:-1] + (ORDER - 1) * np.arange(n)
    padded[np.arange(len(symbols)) + np.repeat((ORDER - 1) * (np.arange(n) + 1), lengths)] = symbols
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    packed = np.zeros(len(padded), np.int64)
    for j in range(ORDER):
        packed[ORDER - 1 :] |= padded[ORDER - 1 - j : len(padded) - j] << np.int64(BITS * j)
    at = np.arange(len(symbols)) + np.repeat(first + ORDER - 1 - kept[:-1], lengths)
    return packed[at], kept


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> code, toxic and ordinary count; counted per task, in bounded parts, before anything is shuffled."""
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    for batch in arrays.slices(batches):
        toxic = np.asarray(batch.column(1).to_pylist(), np.int64)
        packed, first = codes(*arrays.text_bytes(batch.column(0)))
        label = np.repeat(toxic, np.diff(first))
        code, back = np.unique(packed, return_inverse=True)
        ones = np.bincount(back, weights=label, minlength=len(code)).astype(np.int64)
        every = np.bincount(back, minlength=len(code))
        code, back = np.unique(np.concatenate([held[0], code]), return_inverse=True)
        held = (code, *(np.bincount(back, weights=np.concatenate(x), minlength=len(code)).astype(np.int64) for x in ((held[1], ones), (held[2], every - ones))))
        if len(code) > HELD:
            yield _table(*held)
            held = tuple(np.zeros(0, np.int64) for _ in range(3))
    yield _table(*held)


def _table(code: np.ndarray, t: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(t), pa.array(o)], names=["code", "t", "o"])


def expression_counts(rows: DataFrame) -> DataFrame:
    """rows(text, toxic) -> (code, t, o): how often each expression stands in toxic and in ordinary texts."""
    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(_count, "code long, t long, o long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(code, t, o) -> (code, llr, n): log p(last character | context) under the toxic less the ordinary model, for seen
    expressions, and for an expression seen in neither class under code -1 - context; n
    is how often the expression or context was counted."""
    shared = _continuation(counts)
    last = F.col("code").bitwiseAND(int(_MASK))
    context = F.shiftright("code", BITS)
    by_context = counts.groupBy(context.alias("context")).agg(
        *(F.sum(c).alias(f"n_{c}") for c in "to"), *(F.sum((F.col(c) > 0).cast("int")).alias(f"types_{c}") for c in "to")
    )

    def weight(c: str) -> Column:
        return F.when(F.col(f"n_{c}") > 0, DISCOUNT * F.col(f"types_{c}") / F.col(f"n_{c}")).otherwise(1.0)

    def seen(c: str) -> Column:
        return F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0)

    lower = counts.select("code", "t", "o", context.alias("context"), (F.col("code").bitwiseAND((1 << BITS * (ORDER - 1)) - 1)).alias("suffix"), last.alias("last"))
    full = lower.join(by_context, "context").join(shared, "suffix")
    known = full.select("code", (F.log(seen("t") + weight("t") * F.col("p")) - F.log(seen("o") + weight("o") * F.col("p"))).alias("llr"), (F.col("t") + F.col("o")).alias("n"))
    unknown = by_context.select((-1 - F.col("context")).alias("code"), (F.log(weight("t")) - F.log(weight("o"))).alias("llr"), (F.col("n_t") + F.col("n_o")).alias("n"))
    return known.union(unknown)


def _continuation(counts: DataFrame) -> DataFrame:
    """Shared Kneser-Ney backoff: (suffix, p) for each suffix of ORDER - 1 characters, p of its last one given the rest.

    A suffix counts once for each distinct character before it; the same holds one order further down, to single
    characters and a uniform floor. Each table is made of the next longer one, whose rows are distinct already.
    """
    tables, longer = {}, counts.select(F.col("code").alias("suffix"))
    for size in range(ORDER - 1, 0, -1):
        shorter = F.col("suffix").bitwiseAND((1 << BITS * size) - 1)
        longer = tables[size] = cut(longer.groupBy(shorter.alias("suffix")).agg(F.count(F.lit(1)).alias("n")))
    below = None
    for size in range(1, ORDER):
        table = tables[size].withColumn("context", F.shiftright("suffix", BITS))
        totals = table.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        table = table.join(totals, "context")
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        rest = DISCOUNT * F.col("types") / F.col("total")
        if below is None:
            below = table.select("suffix", (own + rest / (1 << BITS)).alias("p"))
        else:
            shorter = F.col("suffix").bitwiseAND((1 << BITS * (size - 1)) - 1)
            below = table.withColumn("shorter", shorter).join(below.toDF("shorter", "q"), "shorter").select("suffix", (own + rest * F.col("q")).alias("p"))
    return below


class Lookup:
    """Log ratios by code: open hash tables of fixed width, the later ones for what collided in the earlier."""

    def __init__(self, code: np.ndarray, llr: np.ndarray):
        self.levels = []
        bits = max(10, int(len(code)).bit_length() + 2)
        while len(code):
            multiplier = arrays._PLACE[len(self.levels)]
            slot = (code.astype(np.uint64) * multiplier >> np.uint64(64 - bits)).astype(np.int64)
            keys = np.full(1 << bits, np.iinfo(np.int64).min)
            values = np.zeros(1 << bits, np.float32)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], values[slot[first]] = code[first], llr[first]
            self.levels.append((multiplier, np.uint64(64 - bits), keys, values))
            rest = np.ones(len(code), bool)
            rest[first] = False
            code, llr = code[rest], llr[rest]
            bits = max(10, int(len(code)).bit_length() + 2)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and where there is one."""
        value, hit = np.zeros(len(code), np.float32), np.zeros(len(code), bool)
        left = np.arange(len(code))
        for multiplier, shift, keys, values in self.levels:
            slot = (code[left].astype(np.uint64) * multiplier >> shift).astype(np.int64)
            same = keys[slot] == code[left]
            value[left[same]] = values[slot[same]]
            hit[left[same]] = True
            left = left[~same]
            if not len(left):
                break
        return value, hit


def _look_up(packed: np.ndarray, first: np.ndarray, value: np.ndarray, hit: np.ndarray, more: list) -> None:
    """Fill in what was not hit from each text's own (sorted codes, log ratios)."""
    for i, own in enumerate(more):
        at = first[i] + np.flatnonzero(~hit[first[i] : first[i + 1]])
        if own is None or not len(at):
            continue
        place = np.minimum(np.searchsorted(own[0], packed[at]), len(own[0]) - 1)
        same = own[0][place] == packed[at]
        value[at[same]], hit[at[same]] = own[1][place[same]], True


def features(packed: np.ndarray, first: np.ndarray, table: Lookup, more: list | None = None) -> np.ndarray:
    """For each text the mean log ratio of all its characters, and that of its most toxic stretch (0, 0 if empty).
    more: for each text the log ratios that it has besides those of the table, or None."""
    value, hit = table.find(packed)
    if more:
        _look_up(packed, first, value, hit, more)
    if not hit.all():
        context = -1 - (packed >> np.int64(BITS))
        missed = np.flatnonzero(~hit)
        value[missed], hit[missed] = table.find(context[missed])
        if more:
            _look_up(context, first, value, hit, more)
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    n = len(first) - 1
    out = np.zeros((n, 2))
    length = np.diff(first)
    some = length > 0
    out[some, 0] = (total[first[1:]] - total[first[:-1]])[some] / length[some]
    # A stretch ends at each character and begins STRETCH before, or where its text begins.
    end = np.arange(1, len(packed) + 1)
    begin = np.maximum(end - STRETCH, np.repeat(first[:-1], length))
    if len(packed):
        stretch = (total[end] - total[begin]) / STRETCH
        out[some, 1] = np.maximum.reduceat(stretch, first[:-1][some])
    return out


def _features(shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            more = None
            if batch.num_columns > 2:
                pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                more = [(np.array(c, np.int64), np.array(v, np.float32)) if c else None for c, v in pairs]
            found = features(*codes(*arrays.text_bytes(batch.column(1))), shared.value, more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "mean", "stretch"])

    return each


def _missing(shared):
    """(k1, k2, text) -> k1, k2, code: what each text asks for and the table doesn't have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            packed, first = codes(*arrays.text_bytes(batch.column(2)))
            missed = np.flatnonzero(~shared.value.find(packed)[1])
            row = np.searchsorted(first, missed, side="right") - 1
            asked = np.concatenate([packed[missed], -1 - (packed[missed] >> np.int64(BITS))])
            row = np.concatenate([row, row])
            order = np.lexsort([asked, row])
            row, asked = row[order], asked[order]
            keep = ~shared.value.find(asked)[1]
            keep[1:] &= (row[1:] != row[:-1]) | (asked[1:] != asked[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), batch.column(1).take(pa.array(row[keep])), pa.array(asked[keep], pa.int64())], names=["k1", "k2", "code"])

    return each


def _scanned(texts: DataFrame, shared, rest: DataFrame | None) -> DataFrame:
    """texts(doc_id, text) -> doc_id, mean, stretch; rest: the log ratios that are not broadcast."""
    schema = "doc_id long, mean double, stretch double"
    if rest is None:
        return texts.mapInArrow(_features(shared), schema)
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("2"), "text").alias("k2"))
    missing = keyed.select("k1", "k2", "text").mapInArrow(_missing(shared), "k1 long, k2 long, code long").distinct()
    # Copies of a text ask once; a text's list is no longer than the text.
    lists = missing.join(rest, "code").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("code", "llr"))).alias("more"))
    found = keyed.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "more.code", "more.llr")
    return found.mapInArrow(_features(shared), schema)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a logistic curve over standardised columns; weights with the constant last, means, deviations."""
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + ridge * w * np.array([*[1] * x.shape[1], 0])
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, deviation


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_calibration: int = 20_000, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic, ...) -> doc_id, held_out, score (0 to 1), predicted (score >=
    threshold), one row per row of docs.

    Labels are learnt only from rows whose crc32 of doc_id as text, mod 3, is not 1. Of these, four in five (by another
    hash of doc_id) give the counts, all of them; of the rest, at most most_calibration rows, those with the smallest
    hash, fit the logistic curve. most_entries bounds what is broadcast; scores do not depend on it. Labels are no input of a score. Null and empty texts get the score of log ratios 0.
    Null or repeated labels, and labels without a document: a document counts as toxic if any of its labels is 1,
    and does not teach if all are null. Without both classes among the taught rows every score is the share of toxic
    ones (0.5 without any). A null doc_id counts as held out. Repeated rows are scored each; further columns are
    ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    taught = marked.where(~held_out("doc_id")).withColumn("h", F.xxhash64(F.lit("curve"), "doc_id"))
    curve = F.pmod("h", F.lit(5)) == 0
    taught = cut(taught)
    few = taught.count() <= MOST_BROADCAST
    lesson = taught.where(~curve).select("doc_id", "toxic")
    counts = cut(expression_counts(texts.join(F.broadcast(lesson) if few else lesson, "doc_id").select("text", "toxic")))
    ratios = log_ratios(counts)
    rest = None
    if counts.count() > most_entries // 2:
        ratios = cut(ratios)
        if ratios.count() > most_entries:
            # The cutoff in n leaves out all that share it, so the tiers are apart without a join.
            least = ratios.select("n").orderBy(F.desc("n")).limit(most_entries).agg(F.min("n")).first()[0]
            rest = ratios.where(F.col("n") <= least).select("code", "llr")
            ratios = ratios.where(F.col("n") > least)
    table = ratios.select("code", "llr").toPandas()
    shared = spark.sparkContext.broadcast(Lookup(table["code"].to_numpy(np.int64), table["llr"].to_numpy(np.float64)))
    found = _scanned(texts, shared, rest)
    fit_on = cut(taught.where(curve).orderBy("h").limit(most_calibration).select("doc_id", "toxic"))
    rows = _scanned(texts.join(F.broadcast(fit_on), "doc_id").select("doc_id", "text"), shared, rest).join(fit_on, "doc_id").select("mean", "stretch", "toxic").toPandas()
    y = rows["toxic"].to_numpy(np.float64)
    if len(set(y)) == 2:
        order = np.lexsort((rows["stretch"], rows["mean"]))
        w, mean, deviation = _logistic(rows[["mean", "stretch"]].to_numpy()[order], y[order])
        z = sum(float(w[i]) * (F.col(c) - float(mean[i])) / float(deviation[i]) for i, c in enumerate(("mean", "stretch"))) + float(w[-1])
        score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.5)
    scored = found.select("doc_id", held_out("doc_id").alias("held_out"), score.cast("double").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
