"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A data file holds records one after another, each framed as

    uint64 length | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of the payload

in little-endian order. A payload is one flag byte (1: the document id is null), the id as int64, and the
token ids, two bytes each where the vocabulary fits, else four. The index file beside it has one
(int64 id, uint64 offset, uint32 tokens) entry a record, so a reader can fetch records in any shuffled
order without scanning. Checksums are CRC-32 (zlib), masked by rotating right by 15 and adding a constant.

Executors write each shard under a name of their own attempt; only names that a finished task returned
reach the manifest, so a lost or repeated task leaves at most an unlisted file behind.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.llm.common import bucket_of, pick
from terrazzo.session import fresh_path, qualified, staged

MANIFEST = "shard long, data string, index string, n_records long, n_tokens long"
RECORD = "rec long, doc_id long, start long, n_tokens long, ids_crc32 long"
_ENTRY = "<qQI"
_MASK = 0xFFFFFFFF
LEAST = -(1 << 63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & _MASK


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at `at`, and where the next one begins. A wrong checksum raises ValueError."""
    head = bytes(data[at : at + 8])
    size = int.from_bytes(head, "little")
    if len(data) < at + 16 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"record at {at}: the record is cut short or the length's checksum is wrong")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) < size or len(data) < at + 16 + size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"record at {at}: the payload's checksum is wrong")
    return payload, at + 16 + size


@dataclass(frozen=True)
class Encoding:
    """tokenizer: a tokenizers file; end_id is appended to each document; width: bytes a stored id (two do for
    vocabularies up to 65,536); cache: about how many distinct pieces of text a worker remembers, some 40 bytes
    each; slice_bytes: how much text it encodes at a time."""

    tokenizer: str
    end_id: int = 2
    width: int = 2
    cache: int = 400_000
    slice_bytes: int = 2_500_000

    @property
    def kind(self) -> str:
        return {2: "<u2", 4: "<u4"}[self.width]


#: How the tokenizer splits a normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The steps of the tokenizers that pieces are encoded for; others encode whole texts.
STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Pieces of these letters alone keep their form under NFC and get lower case letter by letter.
PLAIN = r"[\x21-\x7e\u00c0-\u012f\u0131-\u024f]*"
_ENCODERS: dict[Encoding, PieceEncoder] = {}


class _Kept(dict):
    """A dictionary that works out a missing value, and keeps those asked for among the last `most` to 2 `most` distinct keys."""

    def __init__(self, work, most: int):
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        got = self[key] = self.work(key) if got is None else got
        return got


class PieceEncoder:
    """Encodes texts by their distinct pieces, remembering those.

    A tokenizer of the STEPS above drops white space and never builds a token across it, so a text's ids are
    those of the pieces between spaces and line feeds, in order. Arrow splits a slice of texts and numbers its
    distinct pieces and finds those that are known; only new ones are looked at here, and ids are laid out by
    number. A piece of plain Latin letters and ASCII signs is split into words and each word goes to the BPE model once; any other piece goes
    through the whole tokenizer. Texts go whole through a tokenizer of any other steps. Tests hold both against
    encoding whole texts.
    """

    def __init__(self, encoding: Encoding):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.of = encoding
        self.tokenizer = Tokenizer.from_file(encoding.tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if max(self.tokenizer.get_vocab_size() - 1, encoding.end_id) >> 8 * encoding.width:
            raise ValueError(f"ids of this vocabulary do not fit in {encoding.width} bytes")
        self.by_piece = self.known_steps()
        self.end = np.array([encoding.end_id], encoding.kind).tobytes()
        self.words = _Kept(self.word, 30_000)
        # known pieces, how many ids each has, and all their ids; " ", which is no piece, stands for the end of a text
        self.pieces, self.size, self.ids = pa.array([" "]), np.ones(1, np.int32), np.array([encoding.end_id], encoding.kind)
        self.packs = [struct.Struct(f"<{n}{'H' if encoding.width == 2 else 'I'}").pack for n in range(16)]
        self.find = regex.compile(WORD_PATTERN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes_as = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def known_steps(self) -> bool:
        """Whether the tokenizer works by STEPS, so that pieces can be encoded apart."""
        made = json.loads(self.tokenizer.to_str())
        steps = {"normalizer": (made["normalizer"] or {}).get("normalizers"), "pre_tokenizer": (made["pre_tokenizer"] or {}).get("pretokenizers")}
        plain = made["model"].get("type") == "BPE" and not made["model"].get("dropout") and not made["model"].get("ignore_merges")
        special = all(a["content"].startswith("<|") and a["special"] and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in made["added_tokens"])
        return steps == STEPS and plain and special

    @classmethod
    def of_worker(cls, encoding: Encoding) -> PieceEncoder:
        """The encoder that this process keeps between tasks."""
        if encoding not in _ENCODERS:
            _ENCODERS[encoding] = cls(encoding)
        return _ENCODERS[encoding]

    def pack(self, ids: list[int]) -> bytes:
        if len(ids) < len(self.packs):
            return self.packs[len(ids)](*ids)
        return struct.pack(f"<{len(ids)}{'H' if self.of.width == 2 else 'I'}", *ids)

    def word(self, word: str) -> bytes:
        model_form = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes_as)
        return self.pack([t.id for t in self.tokenizer.model.tokenize(model_form)])

    def piece(self, piece: str) -> bytes:
        if "<|" in piece or not (piece.isascii() and piece.isalpha() or self.plain(piece)):
            return self.pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        known = self.words
        # most pieces are one word, or one with a comma or full stop: no need to search for the pattern
        piece = piece.lower()
        if piece.isalpha():
            return known[piece]
        if piece[-1:] in (",", ".") and piece[:-1].isalpha():
            return known[piece[:-1]] + known[piece[-1]]
        return b"".join([known[w] for w in self.find(piece)])

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The place of each distinct piece among the known ones; new ones are encoded and added."""
        found = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(found.is_null())
        number = pc.fill_null(found, 0).to_numpy().copy()
        if len(new):
            number[found.is_null().to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
            got = list(map(self.piece, new.to_numpy(zero_copy_only=False).tolist()))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.size = np.concatenate((self.size, np.fromiter(map(len, got), np.int32, len(got)) // self.of.width))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(got), self.of.kind)))
        return number

    def keep(self, some: np.ndarray) -> None:
        """Forget all known pieces but those at `some` places, the first of which is 0."""
        keep = np.zeros(len(self.size), bool)
        keep[some] = True
        self.ids = self.ids[np.repeat(keep, self.size)]
        self.pieces, self.size = self.pieces.filter(pa.array(keep)), self.size[keep]

    def batch(self, texts: pa.Array) -> pa.Array:
        """For each text its ids and the end id, as bytes. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return pa.array([self.pack(e.ids) + self.end for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)], pa.binary())
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special tokens, so capitals of ASCII tell nothing
            texts = pc.ascii_lower(texts)
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        number = self.numbers(numbered.dictionary)
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        code = np.insert(number[numbered.indices.to_numpy()], ends, 0)
        n = self.size[code]
        stop = np.cumsum(n, dtype=np.int32)  # a slice has fewer ids than bytes, and fewer than 2^31 of these
        at = np.repeat((np.cumsum(self.size, dtype=np.int32) - self.size)[code] - (stop - n), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.ids[at]
        bounds = np.concatenate(([0], stop[ends + np.arange(len(ends))])).astype(np.int64) * self.of.width
        if len(self.pieces) > self.of.cache:
            self.keep(np.union1d(number, [0]))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])


def encode(docs: DataFrame, encoding: Encoding, cuts: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Rows (doc_id, ord, tie, shard, ids): the encoded ids as bytes, tie their CRC-32. Null text counts as empty:
    its end id alone. A null order value counts as the least long. A shard has the values from one of the sorted
    `cuts` (exclusive) to the next; a value that several cuts name has as many shards, by tie."""
    cols = {"doc_id": id_col, "text": text_col, "ord": order_col or id_col}
    ordinal = F.coalesce(F.col("ord").cast("long"), F.lit(LEAST))
    source = pick(docs, **cols).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), ordinal.alias("ord"))
    shared = docs.sparkSession.sparkContext.broadcast(np.array([] if cuts is None else cuts, np.int64))  # 8 bytes a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        pa.default_memory_pool().release_unused()  # the worker lives on, what it worked with need not

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm.token_records import PieceEncoder as Kept  # the module's own, so that its cache outlives the task

        encoder, cuts = Kept.of_worker(encoding), shared.value
        for b in batches:
            # slice by slice: a batch of long texts never stands in memory twice
            for lo, hi in slices(b.column("text"), encoding.slice_bytes):
                part = b.slice(lo, hi - lo)
                ids = encoder.batch(part.column("text"))
                tie = np.fromiter((zlib.crc32(x.as_buffer()) for x in ids), np.int64, len(ids))
                value = part.column("ord").to_numpy()
                first, last = np.searchsorted(cuts, value, "left"), np.searchsorted(cuts, value, "right")
                shard = first + (tie * np.maximum(last - first, 1) >> 32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ord"), pa.array(tie), pa.array(shard.astype(np.int32)), ids], ["doc_id", "ord", "tie", "shard", "ids"])

    return source.mapInArrow(run, "doc_id long, ord long, tie long, shard int, ids binary")


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield lo, hi
        lo = hi


def shard_cuts(docs: DataFrame, shard_chars: int, text_col: str, order_col: str, rows: int = 20_000, at_once: int = 1_000) -> np.ndarray:
    """Sorted order values that part `docs` into shards of about `shard_chars` characters, and at most about `rows` rows, each.

    A row weighs one unit, and one more for each shard_chars / rows characters. Beyond `at_once` shards the values
    are first parted into ranges of so many, then each range by itself, so no aggregate holds more points than that.
    """
    rows = max(1, min(rows, shard_chars))
    unit = shard_chars // rows
    units = 1 + F.floor(F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) / unit).cast("int")
    k = F.coalesce(F.col(f"`{order_col}`").cast("long"), F.lit(LEAST))
    sized = docs.select(k.alias("k"), units.alias("u"))
    shards = -(-int(sized.agg(F.sum("u").alias("u")).first().u or 0) // rows)
    each = sized.select("k", F.explode(F.array_repeat(F.lit(True), F.col("u")))).select("k")

    def points(n: int):
        return F.percentile_approx("k", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")

    if shards <= 1:
        return np.array([], np.int64)
    if shards <= at_once:
        return np.array(sorted(each.agg(points(shards)).first().q or []), np.int64)
    ranges = -(-shards // at_once)
    outer = sorted(each.agg(points(ranges)).first().q)
    inner = each.groupBy(bucket_of(F.col("k"), sorted(set(outer))).alias("b")).agg(points(at_once)).select(F.explode("q").alias("q"))
    return np.sort(np.array([*outer, *(r.q for r in inner.toLocalIterator())], np.int64))  # 8 bytes a shard


def write_records(docs: DataFrame, encoding: Encoding, path: str, shard_chars: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Encode `docs` and write them under `path` in ascending order of `order_col` (the id by default).

    Returns the manifest, one row a shard in order. Shards are ranges of the order column of about `shard_chars`
    characters, so their number follows the input. Null order values come first, as the least long; rows that
    share an order value are ordered by the CRC-32 of their ids, then by document id and ids, and a value that
    many rows share is spread over shards by that checksum. An empty table gives an empty manifest.
    """
    cuts = shard_cuts(docs, shard_chars, text_col, order_col or id_col)
    fs_path = qualified(docs.sparkSession, path)
    rows = encode(docs, encoding, cuts, id_col, text_col, order_col)
    dealt = rows.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "ord", "tie", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for shard, doc, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if out is None or out.shard != shard:
                    if out:
                        yield out.close()
                    out = _Shard(fs_path, shard, encoding.width)
                out.add(doc, ids.as_buffer())
        if out:
            yield out.close()

    written = dealt.mapInArrow(run, MANIFEST)
    with small_batches(docs.sparkSession):
        return staged(written, "token-manifest").orderBy("shard")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Within it, what runs hands Python workers batches of so many rows, so long texts take little memory on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Shard:
    def __init__(self, path: str, shard: int, width: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(path)
        self.fs.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        self.shard, self.width, self.names = shard, width, (f"{name}.rec", f"{name}.idx")
        self.prefix = path[: -len(root)] if path.endswith(root) else "file://"
        self.data, self.index = (self.fs.open_output_stream(n) for n in self.names)
        self.at = self.records = self.tokens = 0

    def add(self, doc: int | None, ids) -> None:
        record = frame(b"".join((struct.pack("<Bq", doc is None, doc or 0), memoryview(ids))))
        n = ids.size // self.width
        self.data.write(record)
        self.index.write(struct.pack(_ENTRY, doc or 0, self.at, n))
        self.at, self.records, self.tokens = self.at + len(record), self.records + 1, self.tokens + n

    def close(self) -> pa.RecordBatch:
        self.data.close()
        self.index.close()
        row = [[self.shard], [self.prefix + self.names[0]], [self.prefix + self.names[1]], [self.records], [self.tokens]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "data", "index", "n_records", "n_tokens"])


def read_records(manifest: DataFrame, width: int = 2, seed: int | None = None) -> DataFrame:
    """Rows (rec, doc_id, start, n_tokens, ids_crc32) read from the files: rec is the place in the shard,
    start the number of ids before the record in the whole set; every checksum is verified.

    With a `seed`, records are fetched in a shuffled order: shards in one drawn by hash, and in each shard
    record after record by the offset index, in a permutation drawn from the seed and the shard. The rows are the same.
    """
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "data", "index", before.alias("start"))
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                out = []
                for rec, doc, start, payload in fetch(row.shard, row.data, row.index, seed):
                    ids = np.frombuffer(payload, kind, offset=9)
                    out.append((rec, doc, row.start + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 5000:
                        yield _frame(out)
                        out = []
                if out:
                    yield _frame(out)

    def fetch(shard: int, data: str, index: str, seed: int | None) -> Iterator[tuple[int, int | None, int, memoryview]]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(data)
        _, idx = fs.FileSystem.from_uri(index)
        with system.open_input_stream(idx) as f:
            entries = np.frombuffer(f.read(), np.dtype([("doc", "<i8"), ("at", "<u8"), ("n", "<u4")]))
        at, n = entries["at"].astype(np.int64), entries["n"].astype(np.int64)
        start = np.cumsum(n) - n
        places = np.arange(len(n)) if seed is None else np.random.default_rng((seed, shard)).permutation(len(n))
        with system.open_input_file(name) as f:
            ends = np.append(at[1:], f.size())
            for rec in places.tolist():
                if seed is not None or rec == 0:
                    f.seek(int(at[rec]))
                size = int(ends[rec] - at[rec])
                payload, after = unframe(memoryview(f.read(size)), 0)
                null, doc = struct.unpack_from("<Bq", payload)
                if after != size or len(payload) != 9 + width * n[rec] or doc != entries["doc"][rec]:
                    raise ValueError(f"{name}: the index and the record at {at[rec]} disagree")
                yield rec, None if null else doc, int(start[rec]), payload

    # a task a shard: adaptive execution would merge them, since the manifest itself is tiny
    n = (manifest.agg(F.max("shard").alias("n")).first().n or 0) + 1
    dealt = shards.repartitionById(n, F.col("shard").cast("int")) if seed is None else shards.repartitionById(n, F.pmod(F.xxhash64("shard", F.lit(seed)), F.lit(n)).cast("int"))
    return dealt.mapInPandas(run, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["rec", "doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64"})


def default_encoding() -> Encoding:
    import public_tokenizers

    return Encoding(public_tokenizers.path("word_bpe_49k.json"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as records in ascending doc_id order and read back."""
    encoding = default_encoding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, encoding, fresh_path(spark, "token-records"))
    return read_records(manifest, encoding.width).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op8_token_records": op8_token_records}
ORACLE: dict[str, str] = {}
