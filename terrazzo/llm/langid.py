"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier over hashed letter n-grams predicts each bit. Decoding adds up
the classifiers' logistic losses against every codeword, each bit weighted by how reliable its classifier was in
training, and takes the codeword of least loss. The two best losses give the score and the ambiguity flag.

Features: a text's letters in lower case, everything else one space; counts of 1-, 2- and 3-grams in DIMS hash
buckets; square roots of their shares. Whole texts are counted, in numpy, text by text.

Fitting takes at most about `fit_rows` labelled rows a language, chosen by a hash of the row's id. That bound is
the only one; prediction covers every row and whole texts, and uses the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.common import pick, sheltered
from terrazzo.session import broadcast_if, staged

DIMS_LOG2 = 12
DIMS = 1 << DIMS_LOG2
UNKNOWN = "und"
#: Above this many distinct labels the sample is joined by shuffle.
MAX_BROADCAST_LANGUAGES = 100_000
_SPACE = 32
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    if not _TABLE:
        out = np.full(0x110000, _SPACE, np.uint32)
        for c in [*range(0xD800), *range(0xE000, 0x110000)]:
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(out)
    return _TABLE[0]


def counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of a text's letter n-grams; None if it has no letter."""
    if not text:
        return None
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = x == _SPACE
    x = x[~(gap & np.concatenate(([True], gap[:-1])))]  # no leading space, no two in a row
    if not len(x):
        return None
    out, shift = np.zeros(DIMS, np.int64), np.uint32(32 - DIMS_LOG2)
    h = x * np.uint32(0x9E3779B1)
    out += np.bincount(h >> shift, minlength=DIMS)
    for k, mix in ((1, 0x85EBCA77), (2, 0xC2B2AE3D)):
        if len(x) <= k:
            break
        h = (h[:-1] ^ np.uint32(k)) * np.uint32(mix) + x[k:] * np.uint32(0x27D4EB2F)
        out += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift, minlength=DIMS)
    return out


def features(text: str | None) -> np.ndarray | None:
    c = counts(text)
    return None if c is None else np.sqrt(c / c.sum()).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1 bits: all 2^(n-1) - 1 splits for up to six languages, else the best of random codes
    with 10 log2 n bits."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        bits = np.array([[(c >> k) & 1 for c in range(1, 1 << (n - 1))] for k in range(n - 1)] + [[0] * ((1 << (n - 1)) - 1)])
        return (bits * 2 - 1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        m = rng.integers(0, 2, (n, width)) * 2 - 1
        least = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        if least > far and (np.abs(m.sum(axis=0)) < n).all():
            best, far = m, least
    return best.astype(np.int8)


@dataclass(frozen=True)
class Model:
    """languages: sorted; code: a codeword a language; weights: (bits, DIMS + 1), the last for the constant;
    trust: each bit's share in the decoding."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For rows of features the weighted mean logistic loss against each codeword."""
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        return np.stack([np.logaddexp(0, -margin * row) @ self.trust for row in self.code.astype(np.float32)], axis=1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's index, its score and the second best score for each row."""
        loss = self.losses(x).astype(np.float64)
        p = np.exp((loss.min(axis=1, keepdims=True) - loss) * self.code.shape[1] / 2)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return p.argmax(axis=1), order[:, -1], order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def train(x: np.ndarray, lang: np.ndarray, steps: int = 150, rate: float = 0.05, ridge: float = 1e-5) -> Model:
    """Fit all bits' logistic classifiers at once by full-batch Adam; classes weigh the same."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    at = {c: i for i, c in enumerate(languages)}
    row = np.array([at[c] for c in lang])
    y = code[row].astype(np.float32)
    share = (1 / np.bincount(row, minlength=len(languages))[row]).astype(np.float32)
    share /= share.sum()
    w = np.zeros((code.shape[1], x.shape[1] + 1), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = x @ w[:, :-1].T + w[:, -1]
        g = -y * share[:, None] / (1 + np.exp(np.clip(y * margin, -30, 30)))
        grad = np.concatenate([g.T @ x, g.sum(axis=0)[:, None]], axis=1) * len(languages) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * 20 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    wrong = np.clip((((x @ w[:, :-1].T + w[:, -1]) * y <= 0) * share[:, None]).sum(axis=0), 1e-3, 0.49)
    trust = np.log((1 - wrong) / wrong)
    return Model(languages, code, w, (trust / trust.sum()).astype(np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 800) -> Model | None:
    """A model from rows with a label and a letter; None if there are none.

    The sample keeps each row with the same chance within its language, by a hash of its id, so that about
    `fit_rows` of each language remain. Each language's count covers all rows. Only the sample's bucket
    counts come to the driver.
    """
    d = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    n = staged(d.groupBy("lang").count(), "langid-counts")
    chance = n.select("lang", (F.lit(float(fit_rows)) / F.col("count")).alias("chance"))
    chance = broadcast_if(chance, n.count(), MAX_BROADCAST_LANGUAGES)
    lot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = d.join(chance, "lang").where(lot < F.col("chance")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm.langid import counts as of

        for b in batches:
            lang, at, n = [], [], []
            for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (c := of(t)) is not None:
                    lang.append(l)
                    at.append(np.flatnonzero(c).astype(np.int32))
                    n.append(c[at[-1]].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, kind), pa.array(n, kind)], ["lang", "at", "n"])

    got = sample.mapInArrow(run, "lang string, at array<int>, n array<int>").toPandas().sort_values("lang", kind="stable")
    if not len(got):
        return None
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (at, k) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[i, np.asarray(at)] = np.sqrt(np.asarray(k) / np.sum(k))
    order = np.lexsort((x @ np.arange(DIMS, dtype=np.float32), got["lang"].to_numpy()))  # the same sum whatever the tasks' order
    return train(x[order], got["lang"].to_numpy()[order])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "", ambiguous_below: float = 0.2) -> DataFrame:
    """`docs` with columns lang_pred, score and ambiguous (names begin with `prefix`) after its own.

    A text that is null or has no letter, and every text without a model, gets `und` with score 0 and is
    not ambiguous. Otherwise the score is the best codeword's share of exp(-loss), from 0 to 1, and the
    row is ambiguous if the second best comes within `ambiguous_below`.
    """
    kept = model
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "ambiguous")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = (fields and fields + ", ") + f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrazzo.llm.langid import features as of

        for b in batches:
            texts = b.column(text_col)
            lang, score, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for at in range(0, len(texts), 256):
                x = {i: f for i in range(at, min(at + 256, len(texts))) if kept is not None and (f := of(texts[i].as_py())) is not None}
                if x:
                    best, p, second = kept.decode(np.stack(list(x.values())))
                    for i, k, s, other in zip(x, best, p, second, strict=True):
                        lang[i], score[i], near[i] = kept.languages[k], s, s - other < ambiguous_below
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(near)], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null if the id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def identify(docs: DataFrame, fit_rows: int = 800, fold: int = 4, held: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, ambiguous) for every row of `docs`.

    Learns only from rows whose crc32(doc_id as text) mod `fold` is not `held` and whose label is not null.
    A null doc_id is not held out.
    """
    d = pick(docs, doc_id="doc_id", text="text", lang="lang")
    out = F.coalesce(remainder(F.col("doc_id"), fold) == held, F.lit(False))
    model = fit(d.where(~out), fit_rows=fit_rows)
    return predict(d.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def accept(docs: DataFrame, languages: set[str] | None = None, fit_rows: int = 800, least_score: float = 0.0) -> DataFrame:
    """`docs` without rows whose text has no language (`und`), one outside `languages`, or too low a score.

    The model is fitted on the rows' own labels. Columns and texts stay as they are.
    """
    docs, back = sheltered(docs)
    model = fit(docs, fit_rows=fit_rows)
    p = predict(docs, model, prefix="__")
    keep = (F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least_score)
    if languages is not None:
        keep &= F.col("__lang_pred").isin(sorted(languages))
    return back(p.where(keep).select(*(f"`{c}`" for c in docs.columns)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def crc_remainder(doc_id: int, by: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % by


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
