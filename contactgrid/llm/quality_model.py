"""Quality by co-training: a view of the text's characters and a view of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import bound_batches, free_worker_caches, materialize
from contactgrid.llm.shingles import mix

#: The fit sees at most so many labelled documents, chosen by hash of doc_id.
MAX_LABELLED = 3_000
#: Bins of hashed pairs of neighbouring bytes.
PAIR_BINS = 512
#: Bytes' worth of the average text that is added to each, so that short texts are near the average.
SHRINK = 300
META_BINS = 256
ROUNDS = 3
#: In each round each view gives pseudo-labels to the documents, of all without one, that it is surest of: so many of each class, and as sure as this at least.
PER_ROUND, SURE = 200, 0.95
#: A document is rejected below this combined probability of good quality.
KEEP_AT = 0.5


def count_pairs(texts: list[bytes]) -> np.ndarray:
    """How often each hashed pair of neighbouring bytes is in the whole text."""
    x = np.zeros((len(texts), PAIR_BINS), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        for k in range(0, max(0, len(b) - 1), 1 << 20):
            part = b[k : k + (1 << 20) + 1].astype(np.int32)
            x[i] += np.bincount((part[:-1] * 263 + part[1:]) % PAIR_BINS, minlength=PAIR_BINS)
    return x


def text_view(pairs: np.ndarray, average: np.ndarray) -> np.ndarray:
    """Square roots of the shares of pairs, each text together with SHRINK bytes of the average one."""
    x = pairs + SHRINK * average
    return np.sqrt(x / x.sum(axis=1, keepdims=True))


def _bin(value: str, salt: int) -> int:
    h = salt
    for c in value.encode():
        h = (h * 1_000_003 + c) % 2_147_483_647
    return h % META_BINS


def metadata_view(langs: list, sources: list) -> np.ndarray:
    """Language, source and both together as hashed flags: nothing of the text."""
    x = np.zeros((len(langs), META_BINS), np.float32)
    seen: dict[tuple, int] = {}
    for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
        for salt, v in ((17, lang), (91, source), (5, f"{lang} {source}")):
            key = (salt, v)
            if key not in seen:
                seen[key] = _bin(str(v), salt)
            x[i, seen[key]] = 1
    return x


@dataclass
class View:
    """Logistic regression with a Platt scale fitted on the held-out part of the labelled rows."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-4) -> View:
    """Both classes count alike, however many rows they have. Nesterov steps of a fixed number, so that reruns agree."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    rate = 4 / max(1e-9, float((share[:, None] * x1**2).sum()))
    w = v = np.zeros(x1.shape[1], np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        new = (v - rate * (x1.T @ (share * (p - y)).astype(np.float32) + penalty * np.append(v[:-1], 0))).astype(np.float32)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return View(w[:-1], float(w[-1]))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    if len(set(y.tolist())) < 2:
        return view
    platt = fit(view.margin(x)[:, None].astype(np.float32), y, penalty=1e-3)
    prior = np.log(max(1, (y > 0).sum()) / max(1, (y == 0).sum()))
    return View(view.weights, view.bias, (max(0.0, float(platt.weights[0])), platt.bias + float(prior)))


def _odds(views: list[View], x: list[np.ndarray]) -> np.ndarray:
    p = [np.clip(v.probability(part), 1e-6, 1 - 1e-6) for v, part in zip(views, x, strict=True)]
    return np.stack([np.log(q / (1 - q)) for q in p], axis=1)


@dataclass
class CoTrained:
    text: View
    metadata: View
    average: np.ndarray
    blend: tuple[float, float, float] = (1.0, 1.0, 0.0)

    def views(self, pairs: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        return [text_view(pairs, self.average), metadata]

    def score(self, pairs: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """The two calibrated log-odds, in the blend fitted on held-out rows, as one probability."""
        odds = _odds([self.text, self.metadata], self.views(pairs, metadata))
        return 1 / (1 + np.exp(-(odds @ np.array(self.blend[:2]) + self.blend[2])))


@dataclass
class Rows:
    """Documents with a label, known or given: ids, counted pairs, metadata view, label."""

    ids: np.ndarray
    pairs: np.ndarray
    metadata: np.ndarray
    label: np.ndarray


@dataclass
class Round:
    """A round's views, and the labels that each of them then gives: (doc_id, label), the surest first."""

    text: View
    metadata: View
    by_text: list[tuple[int, float]]
    by_metadata: list[tuple[int, float]]


class CoTraining:
    """The labelled rows, of which one third is held out, and what the views have been taught since."""

    def __init__(self, rows: Rows):
        self.rows = rows
        total = np.maximum(rows.pairs.sum(axis=1, keepdims=True), 1)
        self.average = (rows.pairs / total).sum(axis=0) / max(1, len(total)) + 1e-6
        self.average = self.average / self.average.sum()
        self.known = [text_view(rows.pairs, self.average), rows.metadata]
        place = mix(rows.ids.astype(np.uint64)) % np.uint64(6)  # by hash, so that no order of ids decides
        self.calibrating, self.blending = place == 0, place == 3
        self.held = self.calibrating | self.blending
        self.train = [(x[~self.held], rows.label[~self.held]) for x in self.known]
        self.rounds: list[Round] = []

    def two_classes(self) -> bool:
        return len(set(self.rows.label[~self.held].tolist())) == 2

    def fitted(self) -> list[View]:
        """Both views, fitted on what they were taught and calibrated on half of the held-out rows."""
        return [calibrate(fit(*self.train[k]), self.known[k][self.calibrating], self.rows.label[self.calibrating]) for k in (0, 1)]

    def teach(self, by_text: Rows, by_metadata: Rows) -> None:
        """What one view has labelled, the other learns."""
        for k, given, x in ((1, by_text, by_text.metadata), (0, by_metadata, text_view(by_metadata.pairs, self.average))):
            if len(given.ids):
                self.train[k] = (np.vstack([self.train[k][0], x]), np.concatenate([self.train[k][1], given.label]))

    def model(self) -> CoTrained:
        """The views as they are, blended by a fit on the other half of the held-out rows."""
        views = self.fitted()
        y = self.rows.label[self.blending]
        if len(set(y.tolist())) < 2:
            return CoTrained(*views, self.average)
        blend = fit(_odds(views, [x[self.blending] for x in self.known]).astype(np.float32), y, penalty=1e-3)
        prior = np.log((y > 0).sum() / (y == 0).sum())
        return CoTrained(*views, self.average, (max(0.0, float(blend.weights[0])), max(0.0, float(blend.weights[1])), blend.bias + float(prior)))


def _views(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    free_worker_caches()
    return count_pairs([b"" if t is None else t.encode(errors="replace") for t in f["text"]]), metadata_view(f["lang"].tolist(), f["source"].tolist())


def _rows_of(docs: DataFrame, labels: DataFrame) -> Rows:
    """The documents of labels (doc_id, label), which are few: only they reach the driver. Of rows that share an id the first in the order of views stays."""

    def views(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = np.hstack(_views(f)).astype("<f4")
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "view": [x.tobytes() for x in both]})

    chosen = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(labels), "doc_id")
    rows = chosen.mapInPandas(views, "doc_id bigint, label double, view binary").toPandas().sort_values(["doc_id", "view"]).drop_duplicates("doc_id")
    x = np.frombuffer(b"".join(rows["view"]), "<f4") if len(rows) else np.zeros(0, np.float32)
    x = x.reshape(len(rows), PAIR_BINS + META_BINS)
    return Rows(rows["doc_id"].to_numpy(np.int64), x[:, :PAIR_BINS], x[:, PAIR_BINS:], rows["label"].to_numpy(float))


def _surest(docs: DataFrame, views: list[View], average: np.ndarray, taken: DataFrame) -> list[list[tuple[int, float]]]:
    """For each view the (doc_id, label) that it is surest of among all documents but the taken ones."""

    @F.pandas_udf("text double, metadata double")
    def sure(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        f = pd.DataFrame({"text": text, "lang": lang, "source": source})
        found = [np.zeros((0, 2))]
        for i in range(0, len(f), 500):
            pairs, metadata = _views(f.iloc[i : i + 500])
            found.append(np.stack([views[0].probability(text_view(pairs, average)), views[1].probability(metadata)], axis=1))
        return pd.DataFrame(np.concatenate(found), columns=["text", "metadata"])

    pool = docs.where("doc_id is not null").join(F.broadcast(taken), "doc_id", "left_anti")
    scores = materialize(pool.select("doc_id", sure("text", "lang", "source").alias("p")).select("doc_id", "p.*"), "round-scores")
    found = []
    for view in ("text", "metadata"):
        picked = []
        for label, p in ((1.0, F.col(view)), (0.0, 1 - F.col(view))):
            best = scores.where(p >= SURE).groupBy("doc_id").agg(F.max(p).alias("p")).orderBy(F.col("p").desc(), F.xxhash64("doc_id"), "doc_id").limit(PER_ROUND)
            picked += [(r.doc_id, label) for r in best.collect()]
        found.append(picked)
    return found


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTraining | None:
    """Fits both views on at most MAX_LABELLED labelled documents and on what they then teach each other; None without labels of both classes.

    In each round each view scores all documents that have no label yet, and gives its label to those that it is surest of;
    the other view learns them. Views of these few rows alone reach the driver.
    """
    spark = docs.sparkSession
    picked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") > 0).cast("double").alias("label"))
    picked = materialize(picked.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(MAX_LABELLED), "fit-ids")
    training = CoTraining(_rows_of(docs, picked))
    if not training.two_classes():
        return None
    kind = "doc_id bigint, label double"
    given: list[tuple[int, float]] = []
    for _ in range(rounds):
        views = training.fitted()
        taken = picked.select("doc_id").unionByName(spark.createDataFrame(given, kind).select("doc_id"))
        by_text, by_metadata = _surest(docs, views, training.average, taken)
        training.rounds.append(Round(*views, by_text, by_metadata))
        if not by_text and not by_metadata:
            break
        training.teach(*(_rows_of(docs, spark.createDataFrame(x, kind)) for x in (by_text, by_metadata)))
        given += by_text + by_metadata
    return training


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents' columns, with quality_score (0 to 1) and quality_kept.

    The fitted views, a few thousand numbers, go to the tasks; each scores its documents' whole texts.
    Null or blank text: score 0, rejected. Null lang or source: a value like any other. No labels of both classes: score
    1 for all other texts. Labels of ids without document play no part; of several labels of an id the highest
    holds. Rows alike have equal scores. A column of the input named quality_score or quality_kept is replaced.
    """
    bound_batches(docs.sparkSession)
    trained = co_train(docs, labels)
    model = trained.model() if trained else None
    blank = F.coalesce(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0, F.lit(True))

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        f = pd.DataFrame({"text": text, "lang": lang, "source": source})
        parts = [model.score(*_views(f.iloc[i : i + 500])) for i in range(0, len(f), 500)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rated = score("text", "lang", "source") if model else F.lit(1.0)
    rated = docs.withColumn("quality_score", rated)
    rated = rated.withColumn("quality_score", F.when(blank, F.lit(0.0)).otherwise(F.col("quality_score")))
    return rated.withColumn("quality_kept", F.col("quality_score") >= KEEP_AT)
