"""Operator 5, toxicity by a classifier chain.

The chain predicts the labelled categories one after the other ("low_quality", then "toxic"). Each link is a
logistic regression over the presence of selected words plus the probabilities of all earlier links; while a link
is trained, those come from out-of-fold predictions (folds by a hash of the document), so no later link sees a
prediction that was fitted on its own row. When documents are scored, the earlier links' own probabilities are
fed forward.

The models are fitted on at most `max_labelled` labelled documents (those with the smallest hash of doc_id):
the only bounded sample here. Every one of them takes part with its own labels; rows that share three MinHashes
of their words, as near copies do, weigh one together, so that a large group of copies does not teach its own
words. Every word that tells a category apart beyond chance is a feature, however many those are (the labelled
documents bound them). The fits of a link, one per fold and one over all, run as Spark tasks. Everything else,
scoring included, covers every document and whole texts.

Defined cases: null text counts as empty (it has no words: the intercepts decide); a null label leaves its
row out of that category's training only; labels without a document, and documents without a label, are
fine; without usable labels, or when all agree, a category's probability is the labels' mean (0 without
any); very long texts are read whole; repeated rows each get their own result row; labelled documents with
repeated doc_ids each take part; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, read, small_or_join, stage, tidy

#: (category, Column of the labels table that says whether a document belongs to it)
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))
MAX_LABELLED, LEAST_G, FOLDS, RIDGE = 20_000, 32.0, 5, 1.0
#: What parts words, besides white space: ASCII punctuation and digits.
_PART = bytes(c for c in range(256) if c < 128 and not chr(c).isalpha())
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _PART, bytes(range(97, 123)) + b" " * len(_PART))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words: runs of letters, A-Z in lower case."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def fit_logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, float]:
    """Word weights, weights of the extra dense features, intercept; accelerated gradient on the ridge-penalised loss.

    rows and cols are the places of the ones of a 0/1 matrix, weight is each row's; the intercept is not penalised."""
    n, k = len(y), extra.shape[1]
    # per-feature step sizes: the diagonal of a bound on the Hessian
    per_row = weight * (np.bincount(rows, minlength=n) + np.abs(extra).sum(axis=1) + 1)
    step_w = 1 / (ridge + np.bincount(cols, weights=per_row[rows] / 4, minlength=width))
    step_e = 1 / (ridge + (np.abs(extra) * per_row[:, None] / 4).sum(axis=0))
    step_b = 1 / max(per_row.sum() / 4, 1e-9)
    x = np.zeros(width + k + 1)
    rate = np.average(y, weights=weight) if n else 0.0
    x[-1] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    z, t, steps = x.copy(), 1.0, np.concatenate([step_w, step_e, [step_b]])
    for _ in range(400):
        margin = np.bincount(rows, weights=z[cols], minlength=n) + extra @ z[width:-1] + z[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y)
        grad = np.concatenate([np.bincount(cols, weights=off[rows], minlength=width), extra.T @ off, [off.sum()]])
        grad[:-1] += ridge * z[:-1]
        new = z - steps * grad
        if (grad @ (new - x)) > 0:  # restart the momentum when it points uphill
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = new - x
        z, x, t = new + (t - 1) / after * moved, new, after
        if np.abs(moved).max() < 1e-4:
            break
    return x[:width], x[width:-1], float(x[-1])


def fit_fold(data: dict, c: int, earlier: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Category c fitted on the rows with its label outside a fold (on all of them for the fold FOLDS)."""
    doc, word, y = data["doc"], data["word"], data["labels"][:, c]
    use = ~np.isnan(y) & (data["folds"] != fold)
    mean = float(y[use].mean()) if use.any() else 0.0
    if mean in (0.0, 1.0):
        return np.zeros(data["width"]), np.zeros(earlier.shape[1]), 35.0 if mean else -35.0
    place, at = np.cumsum(use) - 1, use[doc]
    return fit_logistic(place[doc[at]], word[at], earlier[use], y[use], data["weight"][use], data["width"])


def in_tasks(spark: SparkSession, shared):
    """A function (category, earlier probabilities) -> the FOLDS + 1 models, each fitted by a Spark task. shared: the broadcast data of fit_chain."""

    def fits(c: int, earlier: np.ndarray) -> list:
        before = spark.sparkContext.broadcast(earlier)

        def run(batches):
            for batch in batches:
                folds = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pickle.dumps(fit_fold(shared.value, c, before.value, f)) for f in folds], pa.binary())], names=["id", "model"])

        models = [pickle.loads(r["model"]) for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(tidy(run), "id long, model binary").orderBy("id").collect()]
        before.destroy()
        return models

    return fits


def fit_chain(data: dict, fits) -> list[dict]:
    """The links in order. data: doc and word (places of the ones), labels (documents, categories; nan where unknown), folds, weight, width."""
    labels, n, out = data["labels"], len(data["labels"]), []
    earlier = np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y, known = labels[:, c], ~np.isnan(labels[:, c])
        models, held = fits(c, earlier), np.zeros(n)
        for f, (w, e, b) in enumerate(models[:-1]):
            margin = np.clip(np.bincount(data["doc"], weights=w[data["word"]], minlength=n) + earlier @ e + b, -12, 12)
            held[data["folds"] == f] = margin[data["folds"] == f]
        w, e, b = models[-1]
        out.append({"words": w, "earlier": e, "bias": b, "cut": best_cut(held[known], y[known], data["weight"][known])})
        earlier = np.column_stack([earlier, 1 / (1 + np.exp(-held))])
    return out


def best_cut(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit above which a document is put in the category: best F0.5 (precision counts more) on held-out margins, but at least at twice the category's rate."""
    if not y.any():
        return 35.0
    order = np.argsort(-margin, kind="stable")
    hit, said = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    score = 1.25 * hit / (said + 0.25 * hit[-1])
    ends = np.append(margin[order][1:] < margin[order][:-1], True)
    at = int(np.argmax(np.where(ends, score, -1)))
    low = margin[order][at + 1] if at + 1 < len(y) else margin[order][at] - 1
    floor = min(0.5, 2 * float(np.average(y, weights=weight)))
    return max(float(np.log(floor / (1 - floor))), float((margin[order][at] + low) / 2))


def train_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_labelled: int = MAX_LABELLED) -> dict:
    """Fit the chain; what reaches the driver is bounded by the telling words of max_labelled documents."""
    spark = docs.sparkSession
    arrow_limits(spark)
    picked = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.expr(e)).cast("double").alias(f"y{i}") for i, (_, e) in enumerate(categories)))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most max_labelled narrow rows: a proven bound

    def tokens(batches):
        for batch in batches:
            bags = [sorted(words_of(t.as_py())) for t in batch.column("text")]
            cols = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
            names = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([[w.decode("utf-8", "replace") for w in b] for b in bags], pa.list_(pa.string()))], names=[*names, "words"])

    ys = [f"y{i}" for i in range(len(categories))]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", *ys, "text")
    bags = rows.mapInArrow(tidy(tokens), "doc_id long, " + ", ".join(f"{y} double" for y in ys) + ", words array<string>")
    key = F.xxhash64(*(F.coalesce(F.array_min(F.transform("words", lambda w, seed=seed: F.xxhash64(w, F.lit(seed)))), F.lit(0).cast("long")) for seed in range(3)))
    bags = stage(bags.select("doc_id", *ys, "words", key.alias("group"), F.monotonically_increasing_id().alias("row_no")), "toxicity-rows")
    alike = bags.groupBy("group").agg((1 / F.count(F.lit(1))).alias("weight"))
    bags = stage(bags.join(small_or_join(stage(alike, "toxicity-groups"), 10 * MAX_LABELLED), "group"), "toxicity-bags")
    # words by the log-likelihood ratio (G) of their weighted counts with a category, over the whole training set; LEAST_G is beyond chance for 10^6 words
    of = lambda y: F.coalesce(F.sum(F.col("weight") * F.col(y)), F.lit(0.0)).alias(y)
    base = bags.agg(F.sum("weight").alias("n"), *map(of, ys)).first()
    stats = bags.select(F.explode("words").alias("word"), "weight", *ys).groupBy("word").agg(F.sum("weight").alias("n"), *map(of, ys))
    score = F.lit(0.0)
    for y in ys:
        rate = min(max((base[y] or 0) / max(base["n"] or 0, 1e-9), 1e-9), 1 - 1e-9)
        part = lambda seen, expected: F.when(seen > 1e-9, 2 * seen * F.log(seen / expected)).otherwise(0.0)
        score = F.greatest(score, part(F.col(y), F.col("n") * rate) + part(F.col("n") - F.col(y), F.col("n") * (1 - rate)))
    best = stage(stats.withColumn("g", score).filter(F.col("g") >= LEAST_G).select("word"), "toxicity-words")  # a word needs several documents to get there
    vocab = sorted(r["word"] for r in best.collect())
    places = F.broadcast(spark.createDataFrame(list(enumerate(vocab)), "place int, word string"))
    ones = bags.select("row_no", F.explode("words").alias("word")).join(places, "word").groupBy("row_no").agg(F.array_sort(F.collect_list("place")).alias("w"))
    table = bags.select("row_no", "group", "doc_id", "weight", *ys).join(ones, "row_no", "left").orderBy("doc_id", "row_no").toPandas()
    lists = [[] if w is None else list(w) for w in table["w"]]
    doc = np.repeat(np.arange(len(table)), [len(w) for w in lists]).astype(np.int32)
    word = np.array([p for ws in lists for p in ws], np.int32)
    folds = (table["group"].to_numpy(np.int64) >> 8) % FOLDS if len(table) else np.zeros(0, np.int64)  # near copies are in one fold
    data = {"doc": doc, "word": word, "labels": table[ys].to_numpy(float).reshape(len(table), len(ys)), "folds": folds, "weight": table["weight"].to_numpy(float), "width": max(1, len(vocab))}
    shared = spark.sparkContext.broadcast(data)  # bounded by the labelled documents
    links = fit_chain(data, in_tasks(spark, shared))
    shared.destroy()  # the workers forget it
    return {"words": {w.encode(): i for i, w in enumerate(vocab)}, "links": links, "names": [c for c, _ in categories]}


def score_texts(texts, model: dict) -> np.ndarray:
    """Logits (texts, categories), each link fed the probabilities of those before it."""
    names, out = model["words"], np.zeros((len(texts), len(model["links"])))
    for r, text in enumerate(texts):
        found = [names[w] for w in words_of(text) if w in names]
        for c, link in enumerate(model["links"]):
            out[r, c] = np.clip(link["words"][found].sum() + link["earlier"] @ (1 / (1 + np.exp(-out[r, :c]))) + link["bias"], -12, 12)
    return out


def score_chain(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, p_<category> per category, toxic (the last category's verdict), kept (not toxic)."""
    arrow_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the telling words of the labelled documents and their weights

    def run(batches):
        m = shared.value
        for batch in batches:
            logits = score_texts(batch.column(1).to_pylist(), m)
            p = 1 / (1 + np.exp(-logits))
            toxic = logits[:, -1] > m["links"][-1]["cut"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(toxic), pa.array(~toxic)], names=["doc_id", *(f"p_{c}" for c in m["names"]), "toxic", "kept"])

    kind = "doc_id long, " + ", ".join(f"p_{c} double" for c in model["names"]) + ", toxic boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), kind)


def op5_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`, scored by the chain trained on `labels`."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return score_chain(docs, train_chain(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))
