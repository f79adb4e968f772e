"""Operator 10: language identification by a linear-chain conditional random field over words.

Every word with a letter is a position of the chain, the languages are its
labels. A word's score for a language is the sum of learned weights of its
features: affixes of one to four letters, letter n-grams of two and three, and
the word itself if the lexicon holds it. Learned transitions tie neighbours
together. Forward-backward gives each word's probabilities; a document's
language is the one with the largest mean probability over its words, and that
mean is the score. Per word probabilities label code-switched text.

The model is fitted on the driver by stochastic gradients of the conditional
likelihood, on a bounded sample whose bounds are parameters of ``fit``: of each
language ``sample`` labelled documents (those with the least hash of their id),
and of all runs of ``LENGTH`` words that their whole texts fall into ``windows``
runs, first one of each document by hash, then a second one, and so on. Runs are
spliced in pairs, so switches occur. Everything else covers all words of all documents:
the chain is cut in blocks whose transfer matrices are multiplied first, so a
text of any length is labelled exactly, in vectorised steps.

Defined results: null text or text without a letter is ``und`` with score 0;
tokens without a letter don't count; repeated rows get equal results; an empty
table gives no rows, and with no labelled documents to learn from all are ``und``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm._shared import gives_back, slices, texts

SAMPLE = 1_000
WINDOWS = 18_000
LENGTH = 32
BUCKETS = 1 << 18
LEXICON = 20_000
EPOCHS = 4
BLOCK = 128
UNKNOWN = "und"
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LETTER = re.compile(r"[^\W\d_]")


def core(token: str) -> str:
    """The token without what isn't a letter at its ends, in lower case; empty if it has no letter."""
    return _EDGE.sub("", token).lower()


def _mixed(seed: int, columns: list[np.ndarray]) -> np.ndarray:
    """A bucket for each row of characters."""
    h = np.full(len(columns[0]), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, None]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the features of non-empty words: affixes, n-grams, and themselves where the lexicon has them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    last = np.cumsum(size + 2) - 1  # where the words' ">" stand; a word's "<" is size + 1 before
    first = last - size - 1
    number = np.repeat(np.arange(len(words)), size + 2)
    known = np.array([k for k, w in enumerate(words) if w in lexicon], np.int64)
    owners, buckets = [np.arange(len(words)), known], [np.zeros(len(words), np.int64), np.array([zlib.crc32(words[k].encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for k in known.tolist()], np.int64)]
    for k in range(1, 5):
        some = np.flatnonzero(size >= k)
        owners += [some, some]
        buckets += [_mixed(k, [letters[first[some] + 1 + i] for i in range(k)]), _mixed(8 + k, [letters[last[some] - k + i] for i in range(k)])]
    for n in (2, 3):
        within = np.flatnonzero(number[: 1 - n] == number[n - 1 :])
        owners.append(number[within])
        buckets.append(_mixed(16 + n, [letters[within + i] for i in range(n)]))
    return np.concatenate(owners), np.concatenate(buckets)


def scores(words: list[str], model: Model) -> np.ndarray:
    """Summed weights of each word's features."""
    out = np.zeros((len(words), len(model.labels)), np.float32)
    if words:
        owner, bucket = features(words, model.lexicon)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner, model.weights[bucket, k], len(words))
    return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    transition: np.ndarray  # labels x labels, log scores
    lexicon: dict[str, None] = field(default_factory=dict)


class Emissions(dict):
    """Token -> row of ``table``, which holds exp of its scores (row 0: a token without letters, which says nothing)."""

    def __init__(self, model: Model, bound: int = 200_000):
        self.model, self.bound = model, bound
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.table = np.ones((1, len(self.model.labels)), np.float32)

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """Rows of the tokens; tokens not yet known are scored together. Call ``forget`` between batches."""
        new = list(set(tokens).difference(self))
        cores = list(map(core, new))
        self.update((t, 0) for t, c in zip(new, cores, strict=True) if not c)
        worded = [(t, c) for t, c in zip(new, cores, strict=True) if c]
        score = scores([c for _, c in worded], self.model)
        if worded:
            self.update((t, k) for k, (t, _) in enumerate(worded, len(self.table)))
            self.table = np.concatenate([self.table, np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))])
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def forget(self) -> None:
        if len(self) > self.bound:
            self.reset()


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(emission: np.ndarray, lengths: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Label probabilities of every position, see ``messages``."""
    return messages(emission, lengths, jump)[0]


def messages(emission: np.ndarray, lengths: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of every position, and the forward and backward messages they come from; ``emission`` holds the chains one after another, ``jump`` is exp of the transitions.

    Chains are cut into blocks. A block's transfer matrix is the product of its
    steps; messages into blocks follow from products along the chain; then all
    blocks run forward and backward side by side.
    """
    k = emission.shape[1]
    if not len(emission):
        return emission, emission, emission
    counts = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.repeat(np.cumsum(lengths) - lengths, counts) + nth * BLOCK
    size = np.minimum(np.repeat(lengths, counts) - nth * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")  # blocks still going at step t are the first ones
    begin_o, size_o = begin[order], size[order]
    going = np.searchsorted(-size_o, -np.arange(BLOCK), side="left")
    steps = int(size_o[0])
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (len(order), k, k)).copy()
    if int(counts.max()) > 1:
        for t in range(steps):
            n = going[t]
            now = (product[:n] @ jump) * emission[begin_o[:n] + t][:, None, :]
            product[:n] = now / now.sum(axis=(1, 2), keepdims=True)
    into = np.full((len(order), k), 1 / k, np.float32)  # by block, in chain order
    back = np.full((len(order), k), 1 / k, np.float32)
    if int(counts.max()) > 1:
        of = np.empty_like(product)
        of[order] = product
        first = np.cumsum(counts) - counts
        for b in range(1, int(counts.max())):
            at = first[counts > b] + b
            into[at] = _scaled((into[at - 1][:, None, :] @ of[at - 1])[:, 0])
        for b in range(1, int(counts.max())):
            at = first[counts > b] + counts[counts > b] - 1 - b
            back[at] = _scaled((of[at + 1] @ back[at + 1][:, :, None])[:, :, 0])
    message, out = into[order], np.empty_like(emission)
    for t in range(steps):
        n = going[t]
        at = begin_o[:n] + t
        message[:n] = _scaled((message[:n] @ jump) * emission[at])
        out[at] = message[:n]
    message, forward, backward = back[order], out.copy(), np.empty_like(out)
    for t in range(steps - 1, -1, -1):
        n = going[t]
        at = begin_o[:n] + t
        backward[at] = message[:n]
        out[at] = _scaled(out[at] * message[:n])
        message[:n] = _scaled((message[:n] * emission[at]) @ jump.T)
    return out, forward, backward


@gives_back
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of LENGTH words of every text, each with its rank by hash within the text."""
    for whole in batches:
        for batch in slices(whole, 1, 100):
            langs, runs, ranks, hashes = [], [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = [w for w in map(core, text.split()) if w]
                of_text = [" ".join(words[at : at + LENGTH]) for at in range(0, len(words), LENGTH)]
                by_hash = sorted((xxhash.xxh64_intdigest(run.encode("utf-8", "surrogatepass"), seed=at), at) for at, run in enumerate(of_text))
                langs += [lang] * len(of_text)
                runs += [of_text[at] for _, at in by_hash]
                ranks += range(len(of_text))
                hashes += [h >> 1 for h, _ in by_hash]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.string()), pa.array(ranks, pa.int32()), pa.array(hashes, pa.int64())], names=["lang", "run", "rank", "hash"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, windows: int = WINDOWS, most_languages: int = 256) -> Model | None:
    """A model learned from ``windows`` runs of words of ``sample`` rows of each language at most; None if no row has text and language.

    The model holds a column of weights for each language, a megabyte, and is broadcast: more than ``most_languages`` are an error.
    """
    usable = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    spark, ids = df.sparkSession, usable.select("_id", "_lang")
    sizes = ids.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("n")).limit(most_languages + 1).collect()  # one row a language
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: the model would not be small enough to broadcast")
    shares = spark.createDataFrame([(lang, min(1.0, 3 * sample / n)) for lang, n in sizes], "_lang string, _share double")
    # some three times the rows wanted by hash, then exactly the least hashes of each language
    drawn = ids.join(F.broadcast(shares), "_lang").withColumn("_hash", F.xxhash64("_id")).where(F.pmod("_hash", F.lit(1 << 40)) < F.col("_share") * float(1 << 40)).distinct()
    order = Window.partitionBy("_lang").orderBy(F.pmod("_hash", F.lit(1 << 40)), "_id")
    chosen = drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).select("_id", "_lang")
    held = usable.join(F.broadcast(chosen), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))  # `sample` ids a language
    runs = held.select("_lang", "_text").mapInArrow(_windows, "lang string, run string, rank int, hash long")
    rows = runs.orderBy("rank", "hash", "lang", "run").limit(windows).select("lang", "run").collect()  # at most `windows` runs of LENGTH words
    return train(sorted((r[0], r[1].split(" ")) for r in rows)) if rows else None


def train(runs: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Adagrad on the conditional likelihood of labelled word runs, spliced in pairs."""
    labels = sorted({lang for lang, _ in runs})
    words: dict[str, int] = {}
    counts: list[int] = []
    for _, run in runs:
        for w in run:
            at = words.setdefault(w, len(words))
            if at == len(counts):
                counts.append(0)
            counts[at] += 1
    common = sorted((w for w in words if counts[words[w]] > 1), key=lambda w: (-counts[words[w]], w))[:LEXICON]
    model = Model(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32), dict.fromkeys(common))
    owner, flat = features(list(words), model.lexicon)
    flat, size = flat[np.argsort(owner, kind="stable")], np.bincount(owner)
    starts = np.cumsum(size) - size
    rng, k = np.random.default_rng(seed), len(labels)
    ids = [np.array([words[w] for w in run]) for _, run in runs]
    gold = np.array([labels.index(lang) for lang, _ in runs])
    seen_w, seen_t = np.full_like(model.weights, 1e-6), np.full_like(model.transition, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for a in range(0, len(order), 128):
            some = order[a : a + 128]
            if len(some) % 2:
                some = np.append(some, some[0])
            pairs = some.reshape(-1, 2)
            cut = [(int(rng.integers(1, len(ids[x]) + 1)), int(rng.integers(0, len(ids[y])))) if rng.random() < 0.3 else (len(ids[x]), len(ids[y])) for x, y in pairs]
            seqs = [np.concatenate([ids[x][:i], ids[y][j:]]) for (x, y), (i, j) in zip(pairs, cut, strict=True)]
            truth = np.concatenate([np.concatenate([np.full(min(i, len(ids[x])), gold[x]), np.full(len(ids[y]) - j, gold[y])]) for (x, y), (i, j) in zip(pairs, cut, strict=True)])
            at, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
            local, back = np.unique(at, return_inverse=True)
            take = np.concatenate([flat[starts[w] : starts[w] + size[w]] for w in local])
            bounds = np.concatenate([[0], np.cumsum(size[local])[:-1]])
            score = np.add.reduceat(model.weights[take], bounds, axis=0)
            emission = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30)).astype(np.float32)[back]
            jump = np.exp(model.transition)
            gamma, forward, backward = messages(emission, lengths, jump)
            diff = np.eye(k, dtype=np.float32)[truth] - gamma
            by_word = np.zeros((len(local), k), np.float32)
            np.add.at(by_word, back, diff)
            rows, inverse = np.unique(take, return_inverse=True)
            grad = np.zeros((len(rows), k), np.float32)
            np.add.at(grad, inverse, np.repeat(by_word, size[local], axis=0))
            grad -= 1e-3 * model.weights[rows]
            seen_w[rows] += grad * grad
            model.weights[rows] += 0.2 * grad / np.sqrt(seen_w[rows])
            inner = np.ones(len(at), bool)
            inner[np.cumsum(lengths) - lengths] = False
            i = np.flatnonzero(inner)
            joint = forward[i - 1][:, :, None] * jump * (emission[i] * backward[i])[:, None, :]  # expected transitions
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            real = np.zeros((k, k), np.float32)
            np.add.at(real, (truth[i - 1], truth[i]), 1)
            step = real - joint.sum(axis=0) - 1e-2 * model.transition
            seen_t += step * step
            model.transition += 0.1 * step / np.sqrt(seen_t)
    return model


def _labelled(slices: list[str], cache: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities of all tokens, which count, tokens a text)."""
    tokens = [t.split() for t in slices]
    lengths = np.array([len(t) for t in tokens], np.int64)
    at = cache.lookup([w for t in tokens for w in t])
    gamma = posteriors(cache.table[at], lengths[lengths > 0], np.exp(cache.model.transition)) if len(at) else np.zeros((0, len(cache.model.labels)), np.float32)
    cache.forget()
    return gamma, at > 0, lengths


def predict(df: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``. The model is of fixed size and is broadcast."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if model is None:
        return df.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col) if text_col in keep else len(keep)  # the text is not sent twice

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, cache = shared.value.labels, Emissions(shared.value)
        for whole in batches:
            for part in slices(whole, at, 10_000, 1 << 20):
                gamma, counts, lengths = _labelled(texts(part.column(at)), cache)
                ends = np.cumsum(lengths)
                weight = np.concatenate([[0], np.cumsum(counts)])
                total = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma * counts[:, None], axis=0, dtype=np.float64)])
                n = weight[ends] - weight[ends - lengths]
                mean = (total[ends] - total[ends - lengths]) / np.maximum(n, 1)[:, None]
                best = mean.argmax(axis=1)
                pred = [labels[b] if x else UNKNOWN for b, x in zip(best.tolist(), n.tolist(), strict=True)]
                score = np.where(n > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    return df.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(run, schema)


def label_words(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words: array of (word, lang, probability)) for every row: the words of code-switched text, each with its language."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, cache = shared.value.labels, Emissions(shared.value)
        for whole in batches:
            for batch in slices(whole, 1, 10_000, 1 << 20):
                some, out, at = texts(batch.column(1)), [], 0
                gamma, counts, lengths = _labelled(some, cache)
                best = gamma.argmax(axis=1)
                for text, n in zip(some, lengths.tolist(), strict=True):
                    out.append([{"word": w, "lang": labels[best[i]] if counts[i] else None, "p": float(gamma[i, best[i]])} for i, w in enumerate(text.split(), at)])
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])))], names=[id_col, "words"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, words array<struct<word:string,lang:string,p:double>>")


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of rows that is never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row's id (or ``keep`` columns) with ``lang_pred`` and ``score``, by a model learned from the rows that aren't held out."""
    model = fit(df.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(df, model, text_col, keep or (id_col,))
