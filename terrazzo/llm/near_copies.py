"""Near copies of texts: SimHash fingerprints in binary tries propose pairs, the exact Jaccard similarity of word shingles decides.

A text's words are those of `simhash`; its set has each run of five words (fewer words: one run of all of them;
none: the empty set, which is like any other empty set). Texts of similarity 0.8 or more are linked, and a
component is what links connect.

Fingerprint: SimHash of the set, 16 words of 64 bits; a bit is 1 if it is set in over half of the shingles' hashes. The first
word is of their XXH64 values, the others of mixes of those.

Trie over all texts: `simhash.links` joins the trie of all first words with itself, at its budget of 2 of 64 bits.

Tries within buckets: texts of similarity 0.8 differ in about 10 of 64 bits, where a trie over all texts prunes next to
nothing. So texts are dealt to buckets, 100 MinHash values in 25 bands of 4, and each bucket's trie of first words is joined with itself
under a wide budget; what it leaves must be within the budget of all 16 words and of the sets' sizes. Two texts of
similarity s share no bucket with probability (1 - s^4)^25: two in a million at 0.8, less above. A budget lies over five
standard deviations above the bits that differ at 0.8. A bucket of more than BLOCK texts is dealt in blocks, one task a pair of blocks.

Links: in the first round a bucket proposes a least spanning forest of its pairs, so a group of n copies costs about n
comparisons of texts. Then all pairs within the budgets whose texts are still in different components are compared by their shingles' hashes in
the bucket's task, and it proposes those that link. So every link between texts that share a bucket and are within the
budgets is either found or within a component already. Whatever is proposed counts only if the texts themselves are similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import pick, sheltered, text_key
from terrazzo.llm.simhash import keep_first, links, walk
from terrazzo.operators.components import connected_components
from terrazzo.session import staged

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 25, 4, 42
#: 64-bit words of a fingerprint, and the texts of a bucket that one task takes at most, or of each side of a pair of blocks.
WORDS, BLOCK = 16, 1024
#: Sets of fewer shingles differ in up to a quarter more bits, since half of their shingles often agree on none.
SMALL = 64
MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
STEP = np.random.default_rng(SEED + 1).integers(0, 1 << 64, WORDS - 1, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of one text; null counts as empty."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < shingle:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles(text, shingle)), np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """The bucket in each band of a set with these hashes, as signed longs."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 1 << 12):
        part = (h[at : at + (1 << 12), None] ^ MIX[0]) * (MIX[1] | np.uint64(1))
        least = np.minimum(least, part.min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def fingerprint(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The first `words` words of the SimHash of a set with these hashes; the empty set has zeros."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 11):
        part = h[at : at + (1 << 11), None]
        x = part + STEP[: words - 1]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        all_ = np.concatenate([part, x ^ x >> np.uint64(31)], axis=1).astype("<u8")
        ones += np.unpackbits(all_.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def budgets(least: float) -> tuple[int, int, int]:
    """Most bits in which sets of similarity `least` differ: in the first word, in all words, and in all if a set is small."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return tuple(int(np.ceil(k * q + 5.65 * np.sqrt(k * q * (1 - q)))) for k, q in ((64, 1.25 * p), (64 * WORDS, p), (64 * WORDS, 1.25 * p)))


def marks(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (tkey, fp, buckets), one for each row of (tkey, text): the fingerprint's first word and the bucket in each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm import near_copies as n

        for b in batches:
            hs = [n.hashes(t.as_py(), shingle) for t in b.column("text")]
            fp = pa.array(np.array([n.fingerprint(h, 1)[0] for h in hs], np.uint64).view(np.int64))
            at = np.concatenate([n.bands(h) for h in hs]) if hs else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(at) + 1, BANDS, dtype=np.int32), at)
            yield pa.RecordBatch.from_arrays([b.column("tkey"), fp, lists], ["tkey", "fp", "buckets"])

    return texts.select("tkey", "text").mapInArrow(run, "tkey binary, fp long, buckets array<long>")


def sketches(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (tkey, n, sketch, ids), one for each row of (tkey, text): the size of the set, the whole fingerprint and 32 bits of each shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm import near_copies as m

        for b in batches:
            hs = [m.hashes(t.as_py(), shingle) for t in b.column("text")]
            of = pa.array([m.fingerprint(h).tobytes() for h in hs], pa.binary())
            ids = pa.array([np.unique(h.astype("<u4")).tobytes() for h in hs], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("tkey"), pa.array([len(h) for h in hs], pa.int64()), of, ids], ["tkey", "n", "sketch", "ids"])

    return texts.select("tkey", "text").mapInArrow(run, "tkey binary, n long, sketch binary, ids binary")


def plausible(sketch: np.ndarray, n: np.ndarray, part: np.ndarray, cross: np.ndarray | None, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of different `part` that are within all budgets, and their differing bits; `cross` is a mask of the second side, or None."""
    fp, out, (first, most, most_small) = sketch[:, 0], [], budgets(least)
    a = np.arange(len(fp)) if cross is None else np.flatnonzero(~cross)
    b = a if cross is None else np.flatnonzero(cross)
    if len(a) * len(b) <= 4096:
        near = np.triu_indices(len(a), 1) if cross is None else np.indices((len(a), len(b))).reshape(2, -1)
        found = [(a[near[0]], b[near[1]])]
    else:
        a, b = a[np.argsort(fp[a])], b[np.argsort(fp[b])]
        found = ((a[i], b[j]) for i, j in walk(fp[a], None if cross is None else fp[b], first))
    for i, j in found:
        small = np.minimum(n[i], n[j])
        keep = (part[i] != part[j]) & (small >= least * np.maximum(n[i], n[j]) - 1e-6)
        i, j, small = i[keep], j[keep], small[keep]
        for at in range(0, len(i), 1 << 15):
            s = slice(at, at + (1 << 15))
            bits = np.bitwise_count(sketch[i[s]] ^ sketch[j[s]]).sum(axis=1, dtype=np.int64)
            keep = bits <= np.where(small[s] < SMALL, most_small, most)
            out.append((i[s][keep], j[s][keep], bits[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def least_forest(part: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of pairs that make a least spanning forest of parts; ties go to the earlier pair."""
    label, taken = part.copy(), []
    rank = np.empty(len(i), np.int64)
    rank[np.argsort(bits, kind="stable")] = np.arange(len(i))
    at = np.argsort(rank)
    live = np.arange(len(i))
    while len(live):
        li, lj = label[i[live]], label[j[live]]
        live, li, lj = live[li != lj], li[li != lj], lj[li != lj]
        if not len(live):
            break
        best = np.full(label.max() + 1, len(i), np.int64)
        np.minimum.at(best, li, rank[live])
        np.minimum.at(best, lj, rank[live])
        new = at[np.unique(best[best < len(i)])]
        taken.append(new)
        up = np.arange(label.max() + 1)
        x, y = label[i[new]], label[j[new]]
        while (differ := up[x] != up[y]).any():
            x, y = x[differ], y[differ]
            np.minimum.at(up, np.maximum(up[x], up[y]), np.minimum(up[x], up[y]))
            while (up != (upper := up[up])).any():
                up = upper
        label = up[label]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def linking(part: np.ndarray, i: np.ndarray, j: np.ndarray, bits: np.ndarray, ids: list[np.ndarray], n: np.ndarray, least: float = SIMILARITY) -> list[int]:
    """The places of pairs that are similar by their shingles' hashes, without those between parts that pairs before have linked.

    Hashes of 32 bits may collide, so a pair that lacks one shingle is among the result, too.
    """
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j])).tolist()
    value, at = np.unique(np.concatenate([ids[k] for k in used]), return_inverse=True)
    at = dict(zip(used, np.split(at, np.cumsum([len(ids[k]) for k in used])[:-1]), strict=True))
    has, last, label, n, taken = np.zeros(len(value), bool), None, part.tolist(), n.tolist(), []
    order = np.lexsort((bits, i))
    for p, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        if label[x] == label[y]:
            continue
        if x != last:
            if last is not None:
                has[at[last]] = False
            has[at[x]] = True
            last = x
        both = int(np.count_nonzero(has[at[y]]))
        if both + 1 >= least * (n[x] + n[y] - both - 1):
            taken.append(p)
            if both >= least * (n[x] + n[y] - both):
                old, new = label[y], label[x]
                label = [new if k == old else k for k in label]
    return taken


def proposals(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows (src, dst), src < dst, of texts that may be linked, from rows (bucket, tkey, root, n, sketch).

    Only texts of different roots make a pair. Each bucket gives a least spanning forest of the pairs within the budgets;
    with a further column `ids` it gives those of all pairs that link roots by their shingles' hashes.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("tkey"), F.col("k")).cast("int")
    dealt = rows.join(sizes, "bucket").withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).drop("k", "o")
    exact = "ids" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm import near_copies as m

        for t, edges in m._whole_groups(batches, ["bucket", "i", "j"]):
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u8").reshape(len(t), m.WORDS)
            n, i, j, own = (t[c].to_numpy() for c in ("n", "i", "j", "own"))
            part = np.unique(np.array(t["root"].to_pylist(), "S16"), return_inverse=True)[1]
            ids = [np.frombuffer(x, "<u4") for x in t["ids"].to_pylist()] if exact else []
            keys, pairs = t["tkey"].to_pylist(), {}
            for lo, hi in zip(edges, edges[1:], strict=False):
                s = slice(lo, hi)
                local = np.unique(part[s], return_inverse=True)[1]
                x, y, bits = m.plausible(sketch[s], n[s], local, None if i[lo] == j[lo] else own[s] == j[lo], least)
                at = m.linking(local, x, y, bits, ids[s], n[s], least) if exact else m.least_forest(local, x, y, bits)
                for a, b in zip(x[at].tolist(), y[at].tolist(), strict=True):
                    a, b = keys[lo + a], keys[lo + b]
                    pairs[(a, b) if a < b else (b, a)] = None
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["src", "dst"])

    group = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return group.mapInArrow(run, "src binary, dst binary").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of sorted rows, each with the places where groups begin and its length."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = [t[c].to_numpy() for c in by]
        cut = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist()
        if cut:
            yield t.slice(0, cut[-1]), [0, *cut]
        rest = t.slice(cut[-1] if cut else 0)
    if rest is not None and len(rest):
        yield rest, [0, len(rest)]


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Those rows (src, dst) of `pairs` whose texts have a similarity of `least` or more."""
    a = texts.select(F.col("tkey").alias("src"), F.col("text").alias("a"))
    b = texts.select(F.col("tkey").alias("dst"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm.near_copies import shingles as of
        from terrazzo.llm.near_copies import similarity as alike

        last, of_last = None, set()
        for x in batches:
            keep = []
            for s, t in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True):
                if s != last:
                    last, of_last = s, of(s, shingle)
                keep.append(alike(of_last, of(t, shingle)) >= least)
            yield x.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "dst").join(a, "src").mapInArrow(run, "src binary, dst binary")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, tkey, fp, component_id), one for each row of `docs`; fp is the digest that stands for the component.

    component_id is the smallest document id of the component, null if all ids there are null.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_key(F.col("text")).alias("tkey"), F.col("text").cast("string").alias("text"))
    ids = staged(d.select("doc_id", "tkey"), "near-ids")
    of_text = staged(marks(d, shingle).dropDuplicates(["tkey"]), "near-marks")
    # the trie over all texts: a forest of fingerprints, each with its texts around the smallest of them
    leaves = staged(of_text.groupBy("fp").agg(F.min("tkey").alias("first"), F.count("*").alias("n")), "near-leaves")
    ends = links(leaves.select("fp")).join(leaves.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src")
    ends = ends.join(leaves.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    ends = ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    around = of_text.join(leaves.where("n > 1"), "fp").where("tkey <> first").select(F.col("first").alias("src"), F.col("tkey").alias("dst"))
    by_trie = staged(ends.unionByName(around).distinct(), "near-trie")
    # the tries within buckets
    at = of_text.select(F.explode("buckets").alias("bucket"), "tkey")
    shared = at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    open_ = staged(at.join(shared, "bucket"), "near-open")
    some = open_.select("tkey").union(by_trie.select("src")).union(by_trie.select("dst")).distinct()
    texts = staged(d.join(some, "tkey", "left_semi").groupBy("tkey").agg(F.first("text").alias("text")), "near-texts")
    sketch = staged(sketches(texts, shingle), "near-sketches")
    rows = open_.join(sketch.drop("ids"), "tkey").withColumn("root", F.col("tkey"))
    tried = staged(proposals(rows, least).unionByName(by_trie).distinct(), "near-tried")
    found = staged(verified(tried, texts, shingle, least), "near-links")
    of = staged(connected_components(found), "near-roots")
    rooted = open_.join(of.withColumnRenamed("node", "tkey"), "tkey", "left").withColumn("root", F.coalesce("component", "tkey")).drop("component")
    split = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket")
    rows = rooted.join(split, "bucket", "left_semi").join(sketch, "tkey")
    more = staged(proposals(rows, least).join(tried, ["src", "dst"], "left_anti"), "near-more")
    last = staged(verified(more, texts, shingle, least), "near-links")
    if not last.isEmpty():
        of = staged(connected_components(found.unionByName(last)), "near-roots")
    by_text = ids.join(of.withColumnRenamed("node", "tkey"), "tkey", "left").select("doc_id", "tkey", F.coalesce("component", "tkey").alias("fp"))
    by_text = staged(by_text, "near-by-text")
    return by_text.join(by_text.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "fp").select("doc_id", "tkey", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each component, chosen as `simhash.deduplicate` does; columns are as they were."""
    docs, back = sheltered(docs)
    return back(keep_first(docs, components(docs, id_col, text_col, shingle, least), id_col, text_col))
