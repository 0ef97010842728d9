"""Source divergence audit (operator 13): how the terms of sources differ within a language.

Two passes over the texts:

1. exact document frequencies; the terms of a language that enough of its documents have are its vocabulary;
2. the recount: workers hold minimal perfect hashes of the vocabulary (broadcast, in shards, with the terms
   themselves for verification), look up what they have gathered and add it to dense slots of each group, a
   language and source. Only counts of kept terms leave them.

The broadcast has a bound. A vocabulary beyond it keeps its most frequent terms in the hashes, as frequency
classes tell; counts of all other terms are summed by a shuffle and meet the rest of the vocabulary in a join.
Both ways give the same counts.

The comparison works on whole numbers. A vocabulary is dealt into blocks of terms; a block with the counts
of all sources of its language is a dense matrix, compared row by row, and gives one sum for each pair.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.llm.perfecthash import PerfectHash, hashes, shard_of
from gaugelake.llm.shared import small, stored

# What the query computes.
MIN_DOCUMENTS, TOP, SCALE, PRIOR = 10, 10, 1_000_000_000, 2

#: Keys of one perfect hash, on average.
SHARD_KEYS = 1 << 16
#: Bytes of all perfect hashes that workers hold; a key counts with its text and 8 more.
HASH_BYTES = 32 * 1024 * 1024
#: Different terms that a worker gathers before it looks them up or hands them on, and slots that it keeps open.
PENDING, OPEN_SLOTS = 200_000, 8_000_000
#: Bytes of a text that are split at a time.
PIECE = 4 * 1024 * 1024
#: Counts (terms times sources) in one block of the comparison.
CELLS = 1 << 18

#: Bytes outside terms become spaces, A to Z lower case; all bytes of multibyte characters are inside.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

_COUNTED = "lang string, source string, term string, n bigint, in_hash boolean"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    clean, start = text.translate(_TERM_BYTES), 0
    while len(clean) - start > PIECE:
        end = clean.find(b" ", start + PIECE)
        if end < 0:
            break
        yield clean[start:end].split()
        start = end
    yield clean[start:].split()


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def document_frequencies(docs: DataFrame, pending: int = PENDING) -> DataFrame:
    """``lang``, ``term`` and in how many rows of ``docs`` (``lang``, ``text``) it is."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[str, Counter] = defaultdict(Counter)

        def gathered() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), _strings(list(terms)), pa.array(list(terms.values()), pa.int64())],
                    names=["lang", "term", "documents"])
            seen.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                terms: set[bytes] = set()
                for part in term_lists(text):
                    terms.update(part)
                own = seen[lang]
                size -= len(own)
                own.update(terms)
                size += len(own)
                if size > pending:
                    yield from gathered()
                    size = 0
        yield from gathered()

    found = docs.select("lang", "text").mapInArrow(count, "lang string, term string, documents bigint")
    return found.groupBy("lang", "term").agg(F.sum("documents").alias("documents"))


def frequency_class(documents: Column) -> Column:
    return F.length(F.bin(documents)).cast("int")


def hashed_from(vocabulary: DataFrame, hash_bytes: int = HASH_BYTES) -> int:
    """The lowest frequency class whose terms, with those of all higher ones, stay below ``hash_bytes``.

    0 if all do; at most 64 rows reach the driver.
    """
    classes = vocabulary.groupBy(frequency_class(F.col("documents")).alias("class")).agg(
        F.sum(F.octet_length("term") + 8).alias("bytes")).orderBy(F.desc("class")).collect()
    total = 0
    for row in classes:
        total += row["bytes"]
        if total > hash_bytes:
            return row["class"] + 1
    return 0


def perfect_hashes(vocabulary: DataFrame, shard_keys: int = SHARD_KEYS) -> dict[str, list[PerfectHash]]:
    """language -> its shards, built on executors from ``lang`` and ``term``."""
    shards = vocabulary.groupBy("lang").agg(F.ceil(F.count("*") / shard_keys).alias("shards"))
    dealt = vocabulary.join(small(shards), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), "shards").alias("shard"))
    dealt = dealt.repartition("lang", "shard")  # a join by language must not decide where shards go

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        terms = rows["term"].cast(pa.binary()).to_pylist()
        return pa.table({"lang": [key[0]], "shard": [key[1]], "body": [pickle.dumps(PerfectHash(sorted(terms)))]})

    built = stored(dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard bigint, body binary"), "perfect-hashes")
    out: dict[str, list[PerfectHash]] = {r["lang"]: [PerfectHash([])] * r["shards"] for r in shards.collect()}
    for row in built.collect():
        out[row["lang"]][row["shard"]] = pickle.loads(row["body"])
    return out


class Slots:
    """Dense counts of groups, a slot for each key of a shard."""

    def __init__(self, shards: dict[str, list[PerfectHash]]):
        self.shards = shards
        self.counts: dict[tuple[str, str, int], np.ndarray] = {}
        self.open = 0

    def add(self, lang: str, source: str, gathered: Counter) -> tuple[list[bytes], np.ndarray]:
        """Count these terms of a group; returns those that no hash has, with their counts."""
        terms, counts = list(gathered), np.fromiter(gathered.values(), np.int64, len(gathered))
        missing = np.ones(len(terms), bool)
        own = self.shards.get(lang)
        if own and terms:
            array, h = pa.array(terms, pa.binary()), hashes(terms)
            shard = shard_of(h, len(own))
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(len(own) + 1))
            for k, hash_ in enumerate(own):
                rows = order[ends[k]:ends[k + 1]]
                if not len(rows):
                    continue
                slots = hash_.slots(array.take(pa.array(rows)), h[rows])
                known = slots >= 0
                if known.any():
                    if (lang, source, k) not in self.counts:
                        self.counts[lang, source, k] = np.zeros(len(hash_), np.int64)
                        self.open += len(hash_)
                    # a key has one slot and comes once, so plain addition counts it
                    self.counts[lang, source, k][slots[known]] += counts[rows[known]]
                    missing[rows[known]] = False
        left = np.flatnonzero(missing)
        return [terms[i] for i in left.tolist()], counts[left]

    def drained(self) -> Iterator[pa.RecordBatch]:
        for (lang, source, k), counts in self.counts.items():
            used = np.flatnonzero(counts)
            yield _batch(lang, source, self.shards[lang][k].keys.take(pa.array(used)).cast(pa.string()), counts[used], True)
        self.counts.clear()
        self.open = 0


def _batch(lang: str, source: str, terms: pa.Array, counts: np.ndarray, in_hash: bool) -> pa.RecordBatch:
    n = len(terms)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(counts, pa.int64()),
         pa.array([in_hash] * n, pa.bool_())], names=["lang", "source", "term", "n", "in_hash"])


def recounted(docs: DataFrame, vocabulary: DataFrame, shard_keys: int = SHARD_KEYS, hash_bytes: int = HASH_BYTES,
              pending: int = PENDING, open_slots: int = OPEN_SLOTS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``: how often each group has each term of its language's vocabulary, where it does."""
    lowest = hashed_from(vocabulary, hash_bytes)
    in_hash = frequency_class(F.col("documents")) >= lowest
    shared = docs.sparkSession.sparkContext.broadcast(perfect_hashes(vocabulary.where(in_hash), shard_keys))
    keep_rest = lowest > 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(shared.value)
        gathered: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        size = 0

        def looked_up() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in gathered.items():
                if slots.open > open_slots:
                    yield from slots.drained()
                rest, counts = slots.add(lang, source, terms)
                if keep_rest and rest:
                    yield _batch(lang, source, _strings(rest), counts, False)
            gathered.clear()

        for batch in batches:
            columns = batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()
            for lang, source, text in zip(*columns, strict=True):
                own = gathered[lang, source]
                size -= len(own)
                for part in term_lists(text):
                    own.update(part)
                size += len(own)
                if size > pending:
                    yield from looked_up()
                    size = 0
        yield from looked_up()
        yield from slots.drained()

    found = docs.select("lang", "source", "text").mapInArrow(count, _COUNTED)
    summed = stored(found.groupBy("lang", "source", "term", "in_hash").agg(F.sum("n").alias("n")), "term-counts")
    kept = summed.where("in_hash").drop("in_hash")
    if keep_rest:
        rest = vocabulary.where(~in_hash).select("lang", "term")
        kept = kept.unionByName(summed.where("NOT in_hash").drop("in_hash").join(rest, ["lang", "term"], "left_semi"))
    return kept


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact for any counts."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0))) div CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0))")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for a matrix of counts and the denominators of its rows, three digits of the quotient at a time."""
    totals = np.maximum(totals, 1)[:, None]
    out, rest = np.zeros_like(counts), counts + PRIOR
    for _ in range(3):  # SCALE is 1000 ** 3
        digits, rest = np.divmod(1000 * rest, totals)
        out = 1000 * out + digits
    return 1 + out


def block_sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One block of a language: for each two of its sources the sum of their differences over the block's terms.

    Rows without a term name the sources and their totals.
    """
    names = rows.filter(pc.is_null(rows["term"]))
    order = sorted(zip(names["source"].to_pylist(), names["total"].to_pylist(), strict=True))
    sources, totals = [s for s, _ in order], np.array([t for _, t in order], np.int64)
    counted = rows.filter(pc.is_valid(rows["term"]))
    terms = pc.dictionary_encode(counted["term"].combine_chunks())
    counts = np.zeros((len(sources), len(terms.dictionary)), np.int64)
    place = {s: i for i, s in enumerate(sources)}
    own = np.array([place[s] for s in counted["source"].to_pylist()], np.int64)
    counts[own, terms.indices.to_numpy()] = counted["n"].to_numpy()
    p = shares(counts, totals)
    sums = [np.zeros(0, np.int64)]
    for a in range(len(sources) - 1):
        sums.append(((p[a] - p[a + 1:]) ** 2 // (p[a] + p[a + 1:])).sum(axis=1))
    first, second = np.triu_indices(len(sources), 1)
    array = pa.array(sources, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(first), pa.string()), "a": array.take(pa.array(first)),
                     "b": array.take(pa.array(second)), "value": pa.array(np.concatenate(sums), pa.int64())})


def pair_sums(counts: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language) and ``value``."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") * F.max("terms") / cells).alias("blocks"))
    sizes = small(sizes.withColumn("blocks", F.greatest("blocks", F.lit(1))))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    names = groups.join(sizes, "lang").select(
        "lang", blocks.alias("block"), "source", (F.col("total") + PRIOR * F.col("terms")).alias("total"),
        F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("n"))
    dealt = counts.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", F.lit(None).cast("bigint").alias("total"), "term", "n")
    both = names.unionByName(dealt).repartition("lang", "block")
    sums = both.groupBy("lang", "block").applyInArrow(block_sums, "lang string, a string, b string, value bigint")
    pairs = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return pairs.select("lang", ways, "value")


def term_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (a term that the source has more of than its language) and ``value``."""
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    spread = counts.withColumn("lang_n", F.sum("n").over(W.partitionBy("lang", "term")))
    shared = spread.join(groups.join(totals, "lang"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    return shared.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def audit(df: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text", cells: int = CELLS, **recount_options) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` compares each group with each other source of its language, part ``term`` names the ``top``
    terms that set it apart from its language. Ranks are by value, then by the item's UTF-8 bytes.

    Each row is a document, repeated ones too; other columns are not read. NULL text, lang and source are
    empty. A group without kept terms has its pairs (0 if its language keeps none) and no terms; a language
    with one source has no pairs; an empty table gives no rows.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (
        ("lang", lang_col), ("source", source_col), ("text", text_col))])
    frequencies = document_frequencies(docs, recount_options.get("pending", PENDING))
    vocabulary = stored(frequencies.where(F.col("documents") >= min_documents), "vocabulary")
    counts = stored(recounted(docs, vocabulary, **recount_options), "kept-counts")

    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
                    .fillna(0, ["total", "terms"]), "groups")

    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(counts, groups, cells).withColumn("rank", F.row_number().over(best))
    terms = term_values(counts, groups).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
