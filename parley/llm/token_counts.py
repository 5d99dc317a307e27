"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of the most frequent pre-tokens of a bounded sample of the documents, broadcast to the
workers; it decides how fast a count is, not what it is. A pre-token is looked up by one hash and verified by another. What misses it goes to a cache that each worker keeps and fills with the tokenizer itself. Pre-tokens
are cut with array operations over code points, by the byte-level pattern
`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .shared import hash_sample, small_batches

#: Entries of tier one: at most 17 bytes each, in memory and in the broadcast.
FREQUENT = 50_000
#: Documents of the sample for tier one, characters that one of them may have, and entries a worker's cache may hold.
SAMPLE, SAMPLE_CHARACTERS, CACHED = 2_000, 100_000, 400_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space of the pattern (fixed values).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_tables: dict[str, np.ndarray] = {}
_cache: dict[str, dict[int, tuple[int, int]]] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        kinds = np.full(0x110000, OTHER, np.uint8)
        kind = {"L": LETTER, "N": NUMBER}
        kinds[:] = [kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
        kinds[_WHITE] = SPACE
        _tables["kinds"] = kinds
        _tables["values"] = arrays.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _tables["kinds"], _tables["values"]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one string, the start of each pre-token in it, each one's two hashes, and each text's first pre-token."""
    kinds, values = _classes()
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if not n:
        return text, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = kinds[points]
    first = np.zeros(n + 1, bool)
    first[heads] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= first[:-1]
    # The last white space before other text stands alone, or leads the next pre-token if it is a blank.
    white = kind == SPACE
    before = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:-1])
    start[before] = True
    start[before[points[before] == 32] + 1] = False
    # Contractions take letters from the run that follows the apostrophe.
    marks = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:-1])
    if len(marks):
        padded = np.append(points, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        two = np.where(first[np.minimum(marks + 2, n)], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        taken = np.where(single, 1, np.where(double, 2, 0))
        marks, taken = marks[taken > 0], taken[taken > 0]
        start[marks + 1] = False
        rest = marks + 1 + taken
        rest = rest[rest < n]
        start[rest] = True
    starts = np.flatnonzero(start)
    lengths = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, lengths)
    hashes, checks = _hashes(values[points], place, starts, lengths)
    return text, starts, hashes, checks, np.searchsorted(starts, heads)


def _hashes(value: np.ndarray, place: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of characters, each of another sum over them."""
    placed = value * arrays._PLACE[place & 63]
    if lengths.max() > 64:
        placed *= arrays._FAR[(place >> 6) & 63] * (np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1))
    sums = [np.add.reduceat(x, starts) + lengths.astype(np.uint64) for x in (placed, placed ^ (placed >> np.uint64(29)))]
    return arrays.mix(sums[0]), sums[1]


def _specials(vocabulary: str) -> re.Pattern | None:
    added = json.loads(vocabulary).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that strip or need word bounds are not supported")
    contents = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, contents))) if contents else None


def _segments(column: pa.Array, special: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the stretches between special strings, the row of each stretch, and the specials of each row."""
    data, offsets = arrays.text_bytes(column)
    rows, extra = np.arange(len(column)), np.zeros(len(column), np.int64)
    if special is not None and special.search(data.tobytes().decode("utf-8")):
        parts = [special.split(t or "") for t in column.to_pylist()]
        extra = np.array([len(p) - 1 for p in parts], np.int64)
        rows = np.repeat(rows, extra + 1)
        data, offsets = arrays.text_bytes(pa.array([s for p in parts for s in p], pa.large_string()))
    return data, offsets, rows, extra


def hashes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that pretokens() gives these strings, each taken as one pre-token."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    return _hashes(_classes()[1][points], np.arange(len(points)) - np.repeat(starts, lengths), starts, lengths)


def frequent_pretokens(texts: list[str], vocabulary: str, most: int) -> list[str]:
    """The pre-tokens that stand in the texts more than once, the most frequent first, `most` of them."""
    found: Counter = Counter()
    for at in range(0, len(texts), 256):
        data, offsets, _, _ = _segments(pa.array(texts[at : at + 256], pa.large_string()), _specials(vocabulary))
        text, starts, *_ = pretokens(data, offsets)
        bounds = [*starts.tolist(), len(text)]
        found.update(text[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
    return [w for w, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most] if n > 1]


def _encoded(tokenizer, text: str, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    parts = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [len(x.ids) for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def _count(vocabulary, table):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary.value)
        special = _specials(vocabulary.value)
        known, known_check, length = table.value
        cache = _cache.setdefault(str(hash(vocabulary.value)), {})
        for batch in arrays.slices(batches):
            data, offsets, rows, extra = _segments(batch.column(1), special)
            text, starts, hashes, checks, heads = pretokens(data, offsets)
            ends = np.append(starts[1:], len(text))
            sizes = np.zeros(len(hashes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                sizes = np.where((known[at] == hashes) & (known_check[at] == checks), length[at], 0).astype(np.int64)
            missed = np.flatnonzero(sizes == 0)
            if len(missed):
                distinct, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
                keys, proofs = distinct.tolist(), checks[missed[at]].tolist()
                cached = [cache.get(h, (0, 0)) for h in keys]
                found = [size if check == proof else 0 for (check, size), proof in zip(cached, proofs, strict=True)]
                new = [i for i, size in enumerate(found) if not size]
                if new:
                    spots = missed[at[new]]
                    if len(cache) + len(new) > CACHED:
                        cache.clear()
                    for i, size in zip(new, _encoded(tokenizer, text, starts[spots], ends[spots]), strict=True):
                        found[i] = size
                        cache[keys[i]] = (proofs[i], size)
                sizes[missed] = np.array(found, np.int64)[back]
                # Other pre-tokens of the same first hash, if ever.
                odd = missed[checks[missed] != np.array(proofs, np.uint64)[back]]
                if len(odd):
                    sizes[odd] = _encoded(tokenizer, text, starts[odd], ends[odd])
            total = np.concatenate([[0], np.cumsum(sizes)])
            of_segment = total[heads[1:]] - total[heads[:-1]]
            tokens = np.bincount(rows, weights=of_segment, minlength=batch.num_rows).astype(np.int64) + extra
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, frequent: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per input row.

    Counts equal those of the `tokenizers` library for the byte-level BPE file at vocabulary_path, without begin or end
    tokens; a special string inside a text is one token, as by the library's default. `frequent` pre-tokens at most of
    `sample` documents, those with the smallest hash of doc_id, are broadcast with their lengths. The file is read on the driver
    and broadcast (its size is fixed). Null and empty texts have 0 bytes and 0 tokens, repeated rows are counted each,
    a null doc_id is carried along, further columns are ignored, an empty table gives no row.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    words = frequent_pretokens([r["text"] for r in hash_sample(docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARACTERS), sample)], vocabulary, frequent)
    sizes = np.array([len(c.ids) for c in Tokenizer.from_str(vocabulary).encode_batch_fast(words, add_special_tokens=False)], np.int64)
    hashes, checks = hashes_of(words) if words else (np.zeros(0, np.uint64),) * 2
    order = np.argsort(hashes)
    fits = order[sizes[order] < 256]
    table = spark.sparkContext.broadcast((hashes[fits], checks[fits], sizes[fits].astype(np.uint8)))
    counted = rows.mapInArrow(_count(spark.sparkContext.broadcast(vocabulary), table), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
