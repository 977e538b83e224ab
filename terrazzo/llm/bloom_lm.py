"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts. Tokens are words ([^ \\t-\\r]+ after lower-casing A-Z) and one end a text. Tasks count the words and word
pairs of their texts as 64-bit hashes, a few million tokens at a time, and send each hash shard its sorted
distinct hashes and their counts; each shard adds them up. The number of shards follows the input, so a
shard stays the same size.

Filter. A count c has level q = 1 + floor(s log2 c), where s is 4 for words and 1 for pairs; the filter of its shard
holds the keys (hash, 1) ... (hash, q). A query asks for level 1, 2, ... until one is absent: a level is never too low,
and too high only by a false positive (BITS_A_KEY bits and PROBES probes a key: about 2 in 100 for each level).

Model. P(w | v) = l * c(v w) / c(v) + (1 - l) * (c(w) + 1) / (N + V + 1), where every count is the middle of its level
and l depends on how many doublings v's count has. The weights l come from a grid, by the likelihood of all training
texts with each pair's own occurrence left out.

Small filters are broadcast (at most BROADCAST_BYTES); workers read larger ones shard by shard from the shared
folder, in the same loop and with the same result, so a worker's memory holds one shard at a time. Each batch of
tokens then reads the shards that it touches, so reads grow faster than the corpus: see the README.

The base score needs exact counts: those of the HEAD most frequent words are looked up in the worker, all others
joined with the count table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.common import pick
from terrazzo.session import fresh_path, staged

HEAD = 1 << 18
BITS_A_KEY, PROBES = 8, 4
BROADCAST_BYTES = 96 << 20
SHARD_CHARS = 24_000_000
FLUSH_TOKENS = 1_200_000
BATCH_TOKENS = 500_000
GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
WORD, PAIR = 0, 1
#: Levels to a doubling of the count.
STEPS = {WORD: 4, PAIR: 1}
END, START = 0xE7D5A1B3C9F02468, 0x1B873593CC9E2D51
_U = np.uint64


def hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens: its words in order, then the end."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(w) + 1, _U)
    out[:-1] = np.fromiter(map(xxh64_intdigest, w), _U, len(w))
    out[-1] = END
    return out


def pair_keys(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    z = (prev * _U(0x9E3779B97F4A7C15)) ^ (word + (prev >> _U(29)))
    z = (z ^ (z >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return z ^ (z >> _U(32))


def previous(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For texts' tokens one after another the token before each; START at the head of each text."""
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[np.cumsum(sizes) - sizes] = START
    return prev


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, the number of each place's key, and how often each occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    back = np.empty(len(keys), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[first], order[first], back, np.diff(np.append(first, len(keys)))


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; `keys` is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, n.astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first, dtype=np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; it never falls as keys grow."""
    return ((keys >> _U(32)) * _U(shards)) >> _U(32)


def level(c: np.ndarray, steps: int = 1) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1)) * steps + 1e-9).astype(np.int64)


def middle(q: np.ndarray, steps: int = 1) -> np.ndarray:
    """The count that a level stands for: 0, then the mean of its integers (1, 2.5, 5.5, ... with one level a doubling)."""
    lo, hi = np.ceil(2.0 ** ((q - 1) / steps) - 1e-9), np.ceil(2.0 ** (q / steps) - 1e-9) - 1
    return np.where(q > 0, np.where(lo <= hi, (lo + hi) / 2, 2.0 ** ((q - 0.5) / steps)), 0.0)


def places(low: np.ndarray, q: int, bits: int) -> list[np.ndarray]:
    z = (low.astype(_U) + _U(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(31))) * _U(0x94D049BB133111EB)
    z ^= z >> _U(29)
    g, step = z & _U(0xFFFFFFFF), (z >> _U(32)) | _U(1)
    return [(g + _U(k) * step) % _U(bits) for k in range(PROBES)]


def build(low: np.ndarray, c: np.ndarray, steps: int = 1) -> bytes:
    """The filter of one shard from the low 32 bits of its hashes and their counts."""
    q = level(c, steps)
    size = max(64, int(q.sum()) * BITS_A_KEY + 7 & ~7)
    on = np.zeros(size, bool)
    for k in range(1, int(q.max(initial=0)) + 1):
        for at in places(low[q >= k], k, size):
            on[at] = True
    return np.packbits(on, bitorder="little").tobytes()


def levels(filt: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each key the last level that the filter holds without a gap."""
    out, left, k = np.zeros(len(low), np.int64), np.arange(len(low)), 1
    while len(left):
        ok = np.ones(len(left), bool)
        for at in places(low[left], k, len(filt) * 8):
            ok &= (filt[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
        left = left[ok]
        out[left] = k
        k += 1
    return out


def count_shards(texts: DataFrame, shards: int) -> DataFrame:
    """Rows (kind, shard, keys, counts, filter, n_keys, n_tokens) from a column `text`: one for each non-empty shard.

    keys are the whole hashes for words, only the low 32 bits for pairs; both are little-endian bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm import bloom_lm as lm

        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            pairs = lm.pair_keys(lm.previous(tokens, np.array([len(x) for x in held])), tokens)
            held.clear()
            for kind, keys in ((lm.WORD, tokens), (lm.PAIR, pairs)):
                keys, n = lm.tally(keys)
                cut = np.searchsorted(lm.shard_of(keys, shards), np.arange(shards + 1))
                n = np.minimum(n, 2**31 - 1).astype(np.int32)
                own = keys if kind == lm.WORD else keys.astype(np.uint32)
                some = np.flatnonzero(np.diff(cut))
                parts = [[a[cut[i] : cut[i + 1]].tobytes() for i in some] for a in (own, n)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int64()), pa.array(some), *map(pa.array, parts)], ["kind", "shard", "keys", "counts"])

        size = 0
        for b in batches:
            for t in b.column("text"):
                held.append(lm.hashes(t.as_py()))
                size += len(held[-1])
                if size >= lm.FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from terrazzo.llm import bloom_lm as lm

        kind, shard = map(int, key)
        keys = np.concatenate([np.frombuffer(x, "<u8" if kind == lm.WORD else "<u4") for x in group["keys"]])
        n = np.concatenate([np.frombuffer(x, "<i4") for x in group["counts"]])
        del group
        keys, n = lm.merge(keys, n)
        filt = lm.build(keys.astype(np.uint32), n, lm.STEPS[kind])
        own = kind == lm.WORD
        return pd.DataFrame({"kind": [kind], "shard": [shard], "keys": [keys.tobytes() if own else b""], "counts": [n.astype("<i8").tobytes() if own else b""], "filter": [filt], "n_keys": [len(keys)], "n_tokens": [int(n.sum())]})

    sent = texts.mapInArrow(count, "kind long, shard long, keys binary, counts binary")
    return sent.groupBy("kind", "shard").applyInPandas(add, "kind long, shard long, keys binary, counts binary, filter binary, n_keys long, n_tokens long")


def word_counts(counted: DataFrame) -> DataFrame:
    """Rows (h, c): each word's hash as a signed long and its count."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), "<i8")), pa.array(np.frombuffer(counts.as_buffer(), "<i8"))], ["h", "c"])

    return counted.where(F.col("kind") == WORD).select("keys", "counts").mapInArrow(unpack, "h long, c long")


@dataclass
class Model:
    """n, v: tokens and distinct tokens in training; head, head_n: the most frequent words' sorted hashes and counts;
    shards: their number; filters: broadcast {(kind, shard): bytes} or None; path: the folder of the filters;
    weights: l for each level of the word before."""

    n: int
    v: int
    head: np.ndarray
    head_n: np.ndarray
    shards: int
    filters: object
    path: str
    weights: np.ndarray

    def filter(self, kind: int, shard: int) -> np.ndarray | None:
        if self.filters is not None:
            found = self.filters.value.get((kind, shard))
            return None if found is None else np.frombuffer(found, np.uint8)
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        for f in system.get_file_info(fs.FileSelector(f"{root}/kind={kind}/shard={shard}", allow_not_found=True)):
            if f.base_name.startswith("part-") and f.size:
                with system.open_input_file(f.path) as file:
                    got = pq.read_table(file, columns=["filter"]).column("filter")
                if len(got):
                    return np.frombuffer(got[0].as_buffer(), np.uint8)
        return None

    def probe(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The level of each of the sorted `keys`."""
        out = np.zeros(len(keys), np.int64)
        cut = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            if (f := self.filter(kind, int(s))) is not None:
                out[cut[s] : cut[s + 1]] = levels(f, keys[cut[s] : cut[s + 1]].astype(np.uint32))
        return out

    def exact(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of those of the words `u` that are head words (0 for others), and which these are."""
        if not len(self.head):
            return np.zeros(len(u)), np.zeros(len(u), bool)
        at = np.minimum(np.searchsorted(self.head, u), len(self.head) - 1)
        found = self.head[at] == u
        return np.where(found, self.head_n[at], 0).astype(np.float64), found

    def pairs(self, tokens: np.ndarray, sizes: np.ndarray, texts: int, left_out: int = 0):
        """For the distinct pairs of the texts' tokens: (P of the word alone, P after its predecessor, the predecessor's
        weight class, how often the pair occurs, the number of each token's pair); left_out: occurrences to take off
        each count. And for the distinct words: (the words, the number of each token's word)."""
        u, _, word, _ = distinct(tokens)
        c = middle(self.probe(WORD, u), STEPS[WORD])
        prev = previous(tokens, sizes)
        keys, at, back, n = distinct(pair_keys(prev, tokens))
        before = np.concatenate(([0], word[:-1]))
        head = np.zeros(len(tokens), bool)
        head[np.cumsum(sizes) - sizes] = True
        c_word, c_prev = c[word[at]], np.where(head[at], float(texts), c[before[at]])
        pair = np.zeros(len(keys))
        both = (c_word > 0) & (c_prev > 0)
        pair[both] = middle(self.probe(PAIR, keys[both]), STEPS[PAIR])
        alone = (np.maximum(c_word - left_out, 0) + 1) / (self.n + self.v + 1)
        after = np.minimum(1.0, np.maximum(pair - left_out, 0) / np.maximum(c_prev - left_out, 1))
        q = np.minimum(level(c_prev) * (c_prev > 0), len(self.weights) - 1)
        return alone, after, q, n, back, u, word


def batches_of(texts: pa.Array, most: int = BATCH_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with their tokens and sizes, about `most` tokens each and one row at least."""
    lo, held, total = 0, [], 0
    for i, t in enumerate(texts):
        held.append(hashes(t.as_py()))
        total += len(held[-1])
        if total >= most or i == len(texts) - 1:
            yield lo, i + 1, np.concatenate(held), np.array([len(x) for x in held])
            lo, held, total = i + 1, [], 0


def fit(texts: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model of a column `text` (no nulls), the word counts, and the number of texts; all texts decide on all of it."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("k")).first()
    shards = max(4, -(-int(size.n or 0) // SHARD_CHARS))
    path = fresh_path(spark, "bloom-filters")
    count_shards(texts, shards).write.partitionBy("kind", "shard").parquet(path)
    counted = spark.read.schema("keys binary, counts binary, filter binary, n_keys long, n_tokens long, kind long, shard long").parquet(path)
    total = counted.where(F.col("kind") == WORD).agg(F.sum("n_tokens").alias("n"), F.sum("n_keys").alias("v")).first()
    words = staged(word_counts(counted), "word-counts")
    top = words.orderBy(F.col("c").desc(), "h").limit(HEAD).toPandas()
    order = np.argsort(top["h"].to_numpy().view(_U))
    head, head_n = top["h"].to_numpy().view(_U)[order], top["c"].to_numpy()[order]
    whole = counted.agg(F.sum(F.length("filter")).alias("n")).first().n or 0
    filters = None
    if whole <= BROADCAST_BYTES:
        got = {(r.kind, r.shard): bytes(r.filter) for r in counted.select("kind", "shard", "filter").toLocalIterator()}
        filters = spark.sparkContext.broadcast(got)
    model = Model(int(total.n or 0), int(total.v or 0), head, head_n, shards, filters, path, np.zeros(64))
    n_texts = int(size.k)
    if n_texts:
        model.weights = weigh(texts, model, n_texts)
    return model, words, n_texts


def weigh(texts: DataFrame, model: Model, n_texts: int) -> np.ndarray:
    """The weight of each class from the sums over all `texts`; a task sends 64 x len(GRID) numbers."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm import bloom_lm as lm

        m = shared.value
        sums = np.zeros((len(m.weights), len(lm.GRID)))
        for b in batches:
            for _, _, tokens, sizes in lm.batches_of(b.column("text")):
                alone, after, q, n, *_ = m.pairs(tokens, sizes, n_texts, 1)
                for k, l in enumerate(lm.GRID):
                    sums[:, k] += np.bincount(q, n * np.log(l * after + (1 - l) * alone), len(sums))
        q, k = np.meshgrid(np.arange(len(sums)), np.arange(len(lm.GRID)), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (q, k, sums)], ["q", "k", "s"])

    got = texts.select("text").mapInArrow(run, "q long, k long, s double").groupBy("q", "k").agg(F.sum("s").alias("s")).toPandas()
    sums = np.zeros((len(model.weights), len(GRID)))
    sums[got["q"], got["k"]] = got["s"]
    return np.where((sums != 0).any(axis=1), GRID[sums.argmax(axis=1)], 0.3)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, train, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    Learns from the rows where `train` (over column doc_id) holds. Null texts count as empty: their end alone.
    base_score is the sum of log10((c + 1) / (N + V + 1)) with exact counts; score the model's log10 probability.
    Without training rows every count is 0, so both are log10(1 / 1) a token.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    kind = d.schema["doc_id"].dataType.simpleString()
    model, words, n_texts = fit(d.where("train").select("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm import bloom_lm as lm

        m = shared.value
        for b in batches:
            for lo, hi, tokens, sizes in lm.batches_of(b.column("text")):
                alone, after, q, _, back, u, word = m.pairs(tokens, sizes, n_texts)
                l = m.weights[q]
                log = np.log10(l * after + (1 - l) * alone)
                c, found = m.exact(u)
                c_log, in_head = np.where(found, np.log10(c + 1), 0.0)[word], found[word]
                start = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x, start)  # noqa: B023, E731
                rest = ~in_head
                n_rest = total(rest.astype(np.int64))
                ends = np.concatenate(([0], np.cumsum(n_rest))).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[rest].view(np.int64)))
                cols = [b.column("doc_id").slice(lo, hi - lo), b.column("train").slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(sizes - n_rest)]
                cols += [pa.array(total(c_log)), pa.array(total(log[back])), tail]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "train", "n_tokens", "head_known", "head_log", "score", "tail"])

    scored = d.mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, head_known long, head_log double, score double, tail array<long>")
    scored = staged(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")  # ids are fixed once written
    tail = scored.select("rid", F.explode("tail").alias("h")).join(words, "h")
    tail = tail.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("tail_log"), F.count("*").alias("tail_known"))
    out = scored.select("rid", "doc_id", "train", "n_tokens", "head_known", "head_log", "score").join(tail, "rid", "left")
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(model.n + model.v + 1)))
    return out.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32(doc_id) mod 7 is not 2; null ids train, null texts are empty."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    s = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held)
    return s.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_bloom_lm": op6_bloom_lm}
ORACLE: dict[str, str] = {}
