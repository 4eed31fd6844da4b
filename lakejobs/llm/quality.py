"""Document quality by hierarchical empirical Bayes.

A logistic classifier, fitted on a bounded sample of labelled documents, gives each document's own
evidence. Evidence is averaged per host and per section of a host over all documents; each host's
mean is shrunk to the global one and each section's to its host's, the more the fewer documents it
has, by strengths estimated from how far sites differ. A document's posterior odds are its own
evidence moved by what the shrunk mean of the other documents of its section says beyond the global one. A document taken for
toxic by its own text is rejected, whatever its quality and its site.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import kept, lean, small_side, with_field
from lakejobs.llm.textbytes import slices, text_bytes, words

TRAINING_ROWS = 12_000  # labelled documents the classifier is fitted on, at most
BUCKETS = 1 << 18  # hashed words
CHOSEN_WORDS = 400  # words with a weight of their own, per target
LEAST_DOCS = 5  # labelled documents that hold a chosen word
SITE_LIMIT = 1.0  # by how much in log odds a site can move a document
THRESHOLD = 0.5
TOXIC = 0.5  # from this probability on a document is rejected

_TYPES = np.zeros((5, 256), bool)  # upper case, digits, symbols, blanks, line ends
_TYPES[0, 0x41:0x5B] = True
_TYPES[1, 0x30:0x3A] = True
_TYPES[2, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_TYPES[2, [ord(c) for c in ",.;:'\"-?()"]] = False
_TYPES[3, [0x20, 0x09]] = True
_TYPES[4, [0x0A, 0x0D]] = True
SHAPE = 14  # columns of ``shape_features``


def shape_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row features of its form; and of all rows the distinct (row, hashed word)."""
    w = words(data, offsets)
    rows, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    count = np.diff(w.first)
    shares = []
    for kind in _TYPES:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        shares.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
    pairs = np.unique(w.row.astype(np.int64) * BUCKETS + (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
    row, bucket = pairs // BUCKETS, pairs % BUCKETS
    some = np.maximum(count, 1)
    repeats = np.bincount(w.row, weights=same, minlength=rows) / some
    distinct = np.bincount(row, minlength=rows) / some
    letters = np.bincount(w.row, weights=(w.ends - w.starts), minlength=rows) / some
    upper, digits, symbols, blanks, lines = shares
    features = [
        np.log1p(count), upper, np.sqrt(upper), digits, np.sqrt(digits), symbols, np.sqrt(symbols), blanks, np.sqrt(lines),
        repeats, np.sqrt(repeats), distinct, np.log1p(letters), (count < 5).astype(float),
    ]
    return np.stack(features, 1), row, bucket


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    shape: np.ndarray  # (targets, SHAPE + 1), the last for the constant
    word: np.ndarray  # (targets, BUCKETS)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(targets, rows): log odds that a document is good, and that it is toxic."""
        x, row, bucket = shape_features(data, offsets)
        x = (x - self.mean) / self.scale
        return np.stack([x @ s[:-1] + s[-1] + np.bincount(row, weights=v[bucket], minlength=len(x)) for s, v in zip(self.shape, self.word, strict=True)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _chosen(y: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Buckets whose share among documents of the two classes differs most."""
    with_word = np.bincount(bucket, minlength=BUCKETS)
    positive = np.bincount(bucket, weights=y[row], minlength=BUCKETS)
    rate = y.mean()
    z = (positive - with_word * rate) / np.sqrt(np.maximum(with_word * rate * (1 - rate), 1e-9))
    z[with_word < LEAST_DOCS] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:CHOSEN_WORDS]
    return np.sort(best[np.abs(z[best]) > 4])


def _fit_one(x: np.ndarray, y: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with a ridge, by Newton steps on the chosen columns."""
    chosen = _chosen(y, row, bucket)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[bucket] >= 0
    z = np.zeros((len(x), SHAPE + 1 + len(chosen)), np.float32)
    z[:, :SHAPE], z[:, SHAPE] = x, 1
    z[row[inside], SHAPE + 1 + place[bucket[inside]]] = 1
    ridge = np.concatenate([np.full(SHAPE, 0.5), [0.01], np.full(len(chosen), 0.5)])
    weights = np.zeros(z.shape[1])
    for _ in range(12):
        p = sigmoid(z @ weights.astype(np.float32))
        step = np.linalg.solve((z * (p * (1 - p)).astype(np.float32)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p).astype(np.float32) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-4:
            break
    word = np.zeros(BUCKETS)
    word[chosen] = weights[SHAPE + 1 :]
    return weights[: SHAPE + 1], word


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The classifier, or None where the labels hold only one quality.

    At most ``rows`` labels are used, in the order of a hash of the id; only their features come to the
    driver. Rows with a null id or quality are not used; null toxicity counts as not toxic.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    chosen = usable.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "quality", "toxic").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            for a, b in slices(offsets):
                x, row, bucket = shape_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                part = batch.slice(a, b - a)
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * SHAPE, pa.int32()), pa.array(x.ravel()))
                held = pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("toxic"), shapes, held], ["quality", "toxic", "shape", "held"])

    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    table = joined.mapInArrow(run, "quality int, toxic int, shape array<double>, held array<int>").limit(2 * rows).toArrow()
    quality = (table.column("quality").to_numpy() > 0).astype(float)
    toxic = (table.column("toxic").to_numpy() > 0).astype(float)
    if quality.size == 0 or quality.min() == quality.max():
        return None
    x = np.concatenate([c.flatten().to_numpy() for c in table.column("shape").chunks]).reshape(-1, SHAPE)
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column("held").chunks])
    bucket = np.concatenate([c.flatten().to_numpy() for c in table.column("held").chunks])
    row = np.repeat(np.arange(len(x)), lengths)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    parts = [_fit_one((x - mean) / scale, y, row, bucket) for y in (quality, toxic)]
    return Model(mean, scale, np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts]))


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_good`` and ``_toxic``: log odds of its own text alone. Null reads as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            for a, b in slices(offsets):
                good, toxic = fitted.logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(good), pa.array(toxic)], [*part.schema.names, "_good", "_toxic"])

    return docs.mapInArrow(lean(run), with_field(docs, "_good", "double").add("_toxic", "double"))


def host_of(source: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(source, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)


def section_of(source: Column, *more: Column) -> Column:
    """The first path segment of a source, and further columns that divide a host."""
    segment = F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*/([^/?#]*)", 1)
    return F.concat_ws("\x1f", segment, *[F.coalesce(c.cast("string"), F.lit("")) for c in more])


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))


def _strength(groups: DataFrame, mean: Column, toward: Column) -> float:
    """How many documents a prior counts for: beta precision by moments over groups (n, mean, square of deviations)."""
    deviation = F.sum(F.col("n") * F.pow(mean - toward, 2))
    inside, between, n, squares, count = groups.agg(
        F.sum("within"), deviation, F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*")
    ).first()
    if not count or count < 2 or n <= count:
        return 10.0
    noise = inside / (n - count)
    spread = (between - (count - 1) * noise) / max(n - squares / n, 1e-9)
    return float(min(max(noise / spread if spread > 0 else 1e6, 1.0), 1e6))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, section, n, s, host_n, host_s, k_host, k_section, site) and the global share of good documents.

    n and s are the documents of a section and the sum of their evidence, host_n and host_s those of its host, the k how many documents a
    prior counts for, ``site`` the section's shrunk share. ``scored`` has host, section and p; sums are
    added up per task, so a host that holds a third of all rows costs a row per task.
    """
    within = F.greatest(F.sum(F.col("p") * F.col("p")) - F.sum("p") * F.sum("p") / F.count("*"), F.lit(0.0))
    sections = scored.groupBy("host", "section").agg(F.count("*").alias("n"), F.sum("p").alias("s"), within.alias("within"))
    sections = kept(sections)
    overall = sections.agg(F.sum("s") / F.sum("n")).first()[0]
    overall = 0.5 if overall is None else overall
    hosts = sections.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("within").alias("within"))
    k_host = _strength(hosts, F.col("s") / F.col("n"), F.lit(overall))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), F.lit(k_host).alias("k_host"))
    sections = sections.join(hosts, "host")
    shrunk_host = (F.col("host_s") + k_host * overall) / (F.col("host_n") + k_host)
    k_section = _strength(sections, F.col("s") / F.col("n"), shrunk_host)
    sections = sections.withColumn("k_section", F.lit(k_section))
    return sections.select("host", "section", "n", "s", "host_n", "host_s", "k_host", "k_section", shrunk_share(overall).alias("site")), overall


def shrunk_share(overall: float, own: Column | None = None) -> Column:
    """A section's share of good documents, shrunk to its host's, which is shrunk to ``overall``; without the document of evidence ``own``."""
    one, p = (0, F.lit(0.0)) if own is None else (1, own)
    less = lambda total: F.greatest(F.col(total) - p, F.lit(0.0))
    host = (less("host_s") + F.col("k_host") * overall) / (F.col("host_n") - one + F.col("k_host"))
    return (less("s") + F.col("k_section") * host) / (F.col("n") - one + F.col("k_section"))


def judged(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", section_cols: tuple[str, ...] = ("lang",),
) -> DataFrame:
    """``docs`` with ``_p_good`` (text alone), ``_p_toxic``, ``_site`` (shrunk share of the others of its section), ``_posterior``, ``_accepted``.

    A document is accepted if its posterior (of its quality) reaches :data:`THRESHOLD` and ``_p_toxic``
    stays below :data:`TOXIC`. Null text is empty text, a null
    source or section an empty name. Without labels of both kinds everything is accepted (posterior 1).
    A column of ``docs`` with one of these names is replaced. Texts are read twice and not shuffled
    unless there are more sections than may be broadcast.
    """
    own, added = _judged(docs, labels, rows, id_col, text_col, source_col, section_cols)
    others = [(i, c) for i, c in enumerate(docs.columns) if c not in added]
    return own.select(*[F.col(f"c{i}").alias(c) for i, c in others], *added)


def _judged(docs, labels, rows, id_col, text_col, source_col, section_cols) -> tuple[DataFrame, tuple[str, ...]]:
    """The documents with their columns called c0, c1, ..., so that no name clashes, and what is added."""
    added = ("_p_good", "_p_toxic", "_site", "_posterior", "_accepted")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())
    model = fit(docs, labels, rows, id_col, text_col)
    if model is None:
        blank = F.lit(None).cast("double")
        return plain.withColumns(dict(zip(added, [blank, blank, blank, F.lit(1.0), F.lit(True)]))), added
    text, source, sections = at[text_col], at[source_col], [at[c] for c in section_cols]
    host, section = host_of(F.col(source)), section_of(F.col(source), *map(F.col, sections))
    own = probability(F.col("_good"))
    used = list(dict.fromkeys([text, source, *sections]))
    scored = with_evidence(plain.select(*used), model, text).select(host.alias("host"), section.alias("section"), own.alias("p"))
    sites, overall = site_posteriors(scored)
    sites = small_side(kept(sites.drop("site").withColumnsRenamed({"host": "_host", "section": "_section"})))
    wide = with_evidence(plain, model, text).withColumns({"_h": host, "_s": section})
    joined = wide.join(sites, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_section")), "left")
    joined = joined.withColumn("_site", shrunk_share(overall, own))  # by the other documents of its site
    shift = log_odds(F.coalesce("_site", F.lit(overall))) - log_odds(F.lit(overall))
    shift = F.least(F.greatest(shift, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    posterior = probability(log_odds(own) + shift)
    judged = joined.withColumns({
        "_p_good": probability(F.col("_good")), "_p_toxic": probability(F.col("_toxic")),
        "_posterior": posterior, "_accepted": (posterior >= THRESHOLD) & (probability(F.col("_toxic")) < TOXIC),
    })
    return judged.select(*at.values(), *added), added


def keep_good(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", section_cols: tuple[str, ...] = ("lang",),
) -> DataFrame:
    """The accepted documents, with their own columns."""
    own, _ = _judged(docs, labels, rows, id_col, text_col, source_col, section_cols)
    return own.where("_accepted").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
