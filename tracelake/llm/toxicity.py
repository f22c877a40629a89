"""Toxicity: a linear-chain conditional random field tags words, its marginals become document scores and offsets.

The given labels are of documents, so words are labelled first: in a toxic document those
that are, by themselves, by their beginning or their end, far more frequent in toxic
documents than in clean ones. The chain (states clean and toxic, one chain for each
sentence) is fitted to these labels; documents are scored by a logistic regression on
their words' forward-backward marginals, fitted on documents that the chain has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, bounded_batches, chosen_share, lean, mixed, passes, span_hashes, text_bytes, word_spans
from tracelake.llm.langid import held_out

BITS, STEPS, RATE, L2 = 18, 40, 0.25, 1e-4
#: What the model is fitted on at most: documents of either class, and bytes of their texts. Chosen by a hash of doc_id.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 2500, 8 << 20
#: Words of a chain: a longer sentence is several chains.
MAX_CHAIN = 256
#: Least likelihood-ratio statistic and odds for a word to be labelled in toxic documents.
MIN_G, MIN_ODDS = 24.0, 6.0

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
ENDS_SENTENCE = np.zeros(256, bool)
ENDS_SENTENCE[[0x0A, 0x21, 0x2E, 0x3F]] = True
#: (length, from the end) of the parts of a word that are features besides the word, and what tells features apart.
PARTS = ((4, False), (5, False), (6, False), (4, True))
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(8)]


@dataclass
class Words:
    starts: np.ndarray  # byte ranges of words, counted from the pass's first byte
    ends: np.ndarray
    first: np.ndarray  # each text's first word, and one more
    chains: np.ndarray  # each sentence's first word, and one more
    own: np.ndarray  # (features of the word itself, words): buckets
    near: np.ndarray  # the same of the word before and after


def words_of(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    whole = span_hashes(data, starts, ends)
    parts = [whole]
    for n, back in PARTS:
        parts.append(span_hashes(data, np.maximum(starts, ends - n), ends) if back else span_hashes(data, starts, np.minimum(starts + n, ends)))
    shift = np.uint64(64 - BITS)
    own = np.stack([(mixed(h + s) >> shift).astype(np.int32) for h, s in zip(parts, _SALTS, strict=False)])
    new = np.zeros(len(starts) + 1, bool)
    new[first] = True
    new = new[:-1]
    if len(starts):
        stops = np.concatenate(([0], np.cumsum(ENDS_SENTENCE[data])))
        new[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    at = np.arange(len(starts))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MAX_CHAIN == 0
    before, after = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    before[1:], after[:-1] = whole[:-1], whole[1:]
    before[new] = 0
    after[:-1][new[1:]] = 0
    near = np.stack([(mixed(h + s) >> shift).astype(np.int32) for h, s in ((before, _SALTS[6]), (after, _SALTS[7]))])
    return Words(starts, ends, first, np.concatenate((np.flatnonzero(new), [len(starts)])), own, near)


def marginals(score: np.ndarray, chains: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward odds of each word, and its probability of being toxic.

    With two states the forward pass is one recursion on odds; all chains go on together, longest first.
    """
    size = np.diff(chains)
    order = np.argsort(-size, kind="stable")
    first, size = chains[:-1][order], size[order]
    lift = np.exp(np.clip(score, -20, 20))
    (a, b), (c, d) = np.exp(trans)
    fore, back = np.empty(len(score)), np.empty(len(score))
    odds = np.ones(len(first))
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for k, n in enumerate(live.tolist()):
        at = first[:n] + k
        odds = lift[at] * ((b + d * odds[:n]) / (a + c * odds[:n]) if k else 1.0)
        np.clip(odds, 1e-12, 1e12, out=odds)
        fore[at] = odds
    last = first + size - 1
    odds = np.ones(0)
    for k in range(len(live)):  # the last words of the longest chains come first, so that all chains end together
        n = len(first) if k == 0 else int(live[k])
        at = last[:n] - k
        if k == 0:
            odds = np.ones(n)
        else:
            x = lift[at + 1] * odds[:n]
            odds = np.clip((c + d * x) / (a + b * x), 1e-12, 1e12)
        back[at] = odds
    p = fore * back
    return fore, back, p / (1 + p)


@dataclass
class Model:
    weights: np.ndarray  # by feature bucket, the last is the bias
    trans: np.ndarray  # log potentials of (state, next state)
    document: np.ndarray  # logistic weights of document_features

    def score_words(self, w: Words) -> np.ndarray:
        total = np.full(w.own.shape[1], self.weights[-1], np.float64)
        for rows in (w.own, w.near):
            for row in rows:
                total += self.weights[row]
        return total

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each document's score, and each word's marginal."""
        p = marginals(self.score_words(w), w.chains, self.trans)[2]
        z = document_features(p, w.first) @ self.document
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: 1, its largest marginal, the log of the expected number of toxic words, and how dense they are."""
    out = np.zeros((len(first) - 1, 4))
    out[:, 0] = 1
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        total = np.add.reduceat(p, first[some])
        out[some, 1] = np.maximum.reduceat(p, first[some])
        out[some, 2] = np.log1p(total)
        out[some, 3] = np.sqrt(total / np.diff(first)[some])
    return out


def word_labels(w: Words, toxic: np.ndarray) -> np.ndarray:
    """1 for words of toxic documents that have a feature which tells toxic documents from clean ones."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(w.first))
    telling = np.zeros((1 << BITS) + 1, bool)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    for row in w.own:
        seen = np.unique(doc.astype(np.int64) << 32 | row)
        bucket, label = (seen & 0xFFFFFFFF).astype(np.int64), toxic[seen >> 32]
        t, c = np.bincount(bucket[label == 1], minlength=1 << BITS), np.bincount(bucket[label == 0], minlength=1 << BITS)
        q = (t + c) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(t > 0, t * np.log(t / (n1 * q)), 0) + np.where(c > 0, c * np.log(c / (n0 * q)), 0))
        telling[:-1] |= (g >= MIN_G) & ((t + 0.5) / n1 >= MIN_ODDS * (c + 0.5) / n0)
    out = np.zeros(len(doc))
    for row in w.own:
        out = np.maximum(out, telling[row])
    return out * toxic[doc]


def fit_chain(w: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that make the labels likely: full-batch Adam on the chain's log likelihood."""
    size = (1 << BITS) + 1
    weights, trans = np.zeros(size), np.zeros((2, 2))
    weights[-1] = -3.0
    first, inner = w.chains[:-1], np.ones(len(y), bool)
    inner[first[first < len(y)]] = False
    pairs = np.flatnonzero(inner)  # words whose predecessor is in their chain
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pairs - 1].astype(int), y[pairs].astype(int)), 1)
    state = [np.zeros(size), np.zeros(size), np.zeros((2, 2)), np.zeros((2, 2))]
    scale = 1.0 / max(1.0, y.sum())
    for step in range(1, STEPS + 1):
        score = np.full(len(y), weights[-1])
        for rows in (w.own, w.near):
            for row in rows:
                score += weights[row]
        fore, back, p = marginals(score, w.chains, trans)
        error = p - y
        grad = np.zeros(size)
        for rows in (w.own, w.near):
            for row in rows:
                grad += np.bincount(row, error, size)
        grad[-1] = error.sum()
        ahead = np.exp(np.clip(score[pairs], -20, 20)) * back[pairs]
        both = np.stack([np.full(len(pairs), np.exp(trans[0, 0])), np.exp(trans[0, 1]) * ahead, np.exp(trans[1, 0]) * fore[pairs - 1], np.exp(trans[1, 1]) * fore[pairs - 1] * ahead])
        expected = (both / both.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(pairs) else seen
        for g, x, m, v in ((grad * scale + L2 * weights, weights, state[0], state[1]), ((expected - seen) * scale + L2 * trans, trans, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return weights, trans


def fit_documents(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_bytes: int) -> tuple[list[tuple[int, str]], float]:
    """(toxic, text) of documents that are not held out; as many as the bounds allow, chosen by hash. A document with both labels is toxic; of rows that repeat a doc_id the least text counts.

    Also the log of how many times the sample's odds of being toxic are those of all labelled documents."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    per_id = texts.select("doc_id", F.octet_length("text").alias("b")).groupBy("doc_id").agg(F.max("b").alias("b"))
    sizes = {r.toxic: (r.n, r.b) for r in per_id.join(known, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()}
    share = {y: min(1.0, most / max(1, sizes.get(y, (0, 0))[0]), max_bytes / 2 / max(1, sizes.get(y, (0, 0))[1] or 0)) for y, most in ((1, max_toxic), (0, max_clean))}
    key = F.xxhash64("doc_id")
    # at most about max_toxic + max_clean ids whatever the number of labels, so their broadcast is bounded and no text is shuffled
    ids = known.where(F.when(F.col("toxic") == 1, chosen_share(key, share[1])).otherwise(chosen_share(key, share[0])))
    # one text of each id, so that an id on many rows neither floods the sample nor empties it
    chosen = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return [(int(r.toxic == 1), r.text) for r in chosen.select("toxic", "text").collect() if r.toxic in (0, 1)], float(np.log(share[1] / share[0]))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model:
    rows, lift = labelled_sample(docs, labels, max_toxic, max_clean, max_bytes)
    rows = sorted(rows)
    rows = [rows[i] for i in np.random.default_rng(7).permutation(len(rows))]
    toxic = np.array([y for y, _ in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        weights = np.zeros((1 << BITS) + 1)
        weights[-1] = -20
        share = (toxic.sum() + 0.5) / (len(toxic) + 1)
        return Model(weights, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    cut = max(1, len(rows) * 2 // 3)
    w = words_of(pa.array([t for _, t in rows[:cut]], pa.large_string()))
    y = word_labels(w, toxic[:cut])
    model = Model(*fit_chain(w, y), np.zeros(4))
    del w
    rest = words_of(pa.array([t for _, t in rows[cut:]], pa.large_string()))
    p = marginals(model.score_words(rest), rest.chains, model.trans)[2]
    model.document = fit_documents(document_features(p, rest.first), toxic[cut:])
    model.document[0] -= lift
    model.weights = model.weights.astype(np.float32)
    return model


def tag(docs: DataFrame, model: Model, min_p: float = 0.5) -> DataFrame:
    """doc_id, score and spans (byte ranges of runs of words with marginals of min_p or more, and the largest of them) of every document.

    A null or empty text has no spans and the score of a document without toxic words.
    Repeated rows are scored each; columns other than doc_id and text play no part.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in passes(batch, "text"):
                _, offsets = text_bytes(part.column(1))
                w = words_of(part.column(1))
                score, p = model.scores(w)
                spans: list[list] = [[] for _ in range(part.num_rows)]
                hit = np.flatnonzero(p >= min_p)
                docs_ = np.searchsorted(w.first, hit, "right") - 1
                last = -2
                for k, d in zip(hit.tolist(), docs_.tolist(), strict=True):
                    if k == last + 1 and spans[d]:
                        spans[d][-1]["to_byte"] = int(w.ends[k] - offsets[d])
                        spans[d][-1]["p"] = max(spans[d][-1]["p"], float(p[k]))
                    else:
                        spans[d].append({"from_byte": int(w.starts[k] - offsets[d]), "to_byte": int(w.ends[k] - offsets[d]), "p": float(p[k])})
                    last = k
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double, spans array<struct<from_byte:long,to_byte:long,p:double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = tag(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
