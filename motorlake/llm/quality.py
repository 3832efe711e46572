"""Quality classifier by co-training on two views of a document.

The text view sees hashed words, their first four and five bytes (those that tell good and bad
labelled rows apart), and shape figures (capitals, signs, repetition, variety, length) as marks of
all levels reached; the metadata view sees source, language and length.  Each view starts from the
labelled rows.  In every round both views score *all* documents, and rows without a label of which
one view is confident (by its calibrated probability) become training rows of the other.  In the end
the views' log-odds, calibrated on held-out labelled rows, are combined and score every document.  A
document is rejected when it is more likely bad (poor or toxic) than not.

Only fitting is bounded: ``max_labelled`` labelled rows and ``max_pseudo`` pseudo-labelled rows for
each view and round, taken in the order of a hash of the id.  Everything else covers all rows:
features are computed in one pass over the texts and kept in files, a few dozen ids a document;
rounds read those.

Defined results: null text, source, language and length are values like others.  A row without a
label, or with null labels, is unlabelled; several labels of one id count as bad if any is.  Without
labelled rows of both kinds nothing can be fitted: scores are null and every document is kept.
Repeated rows are scored one by one.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from motorlake.llm import bytewords
from motorlake.llm.rows import column, free_name, located, text_of, without
from motorlake.session import settle

WORD_BITS = 18
SHAPES = 5
SHAPE_BINS = 24
#: Standard errors by which a word must differ between good and bad rows, and rows that must have it.
DISTINCT, SEEN = 3.5, 3
META_DIM = 1 << 12
MAX_LABELLED = 20_000
MAX_PSEUDO = 5_000
ROUNDS = 2
CONFIDENT = 0.98
PSEUDO_WEIGHT = 0.5
#: Steps of a fit, shrinkage, and tasks that the bounded rows to fit on are dealt to.
STEPS, L2, PARTS = 25, 1e-5, 8
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,'-" for i in range(256)])


def _bin(share: np.ndarray) -> np.ndarray:
    """Shares of 0 to 1 in bins that are finer near 0."""
    return np.minimum((np.sqrt(np.clip(share, 0, 1)) * (SHAPE_BINS - 1)).astype(np.int64), SHAPE_BINS - 1)


def text_features(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each text, distinct, and the bounds of each text's ids.

    The first ids are the shapes' levels.  Words follow: by their hash, or, where ``numbers`` is
    given, by its entry for the hash (words whose entry is below 0 are left out).
    """
    words, bounds, four, five = bytewords.word_hashes(data, offsets, bytewords.NOT_ALNUM, (4, 5))
    n = np.maximum(np.diff(bounds), 1)

    def share(marks: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]) / of

    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    capitals = share(_CAPITAL[data], offsets, np.maximum(letters[offsets[1:]] - letters[offsets[:-1]], 1))
    signs = share(_SIGN[data], offsets, n)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again = share(again, bounds, n)
    mask = np.uint64((1 << WORD_BITS) - 1)
    ids = np.stack([(h & mask).astype(np.int32) for h in (words, bytewords.mix(four + np.uint64(4)), bytewords.mix(five + np.uint64(5)))], axis=1)
    if numbers is not None:
        ids = numbers[ids]
    steps = np.arange(SHAPE_BINS, dtype=np.int32)
    out = []
    for k in range(len(offsets) - 1):
        a, b = bounds[k], bounds[k + 1]
        kinds = len(np.unique(words[a:b]))
        reached = (
            _bin(capitals[k]), _bin(signs[k]), _bin(again[k]), _bin(kinds / (b - a) if b > a else 0), min(int(b - a).bit_length(), SHAPE_BINS - 1)
        )
        own = ids[a:b].ravel()
        own = np.unique(own[own >= 0])
        out.append(np.concatenate([*[i * SHAPE_BINS + steps[: r + 1] for i, r in enumerate(reached)], SHAPES * SHAPE_BINS + own]))
    flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
    return flat, np.cumsum([0, *map(len, out)])


def word_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows and bad rows that have each word hash, and rows and bad rows in all; ``rows`` has text_ids and bad.

    Counted in the tasks: only one number a hash comes to the driver.
    """
    first = SHAPES * SHAPE_BINS
    dim = 1 << WORD_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dim + 1), np.int64)
        for batch in batches:
            ids, at = _lists(batch.column(0))
            bad = batch.column(1).to_numpy().astype(np.int64)
            owner = np.repeat(bad, np.diff(at))[ids >= first]
            ids = ids[ids >= first] - first
            total[0] += np.bincount(ids, minlength=dim + 1)
            total[1] += np.bincount(ids, owner, dim + 1).astype(np.int64)
            total[0, dim] += len(bad)
            total[1, dim] += bad.sum()
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["word", "n", "bad"])

    made = rows.select("text_ids", "bad").mapInArrow(count, "word bigint, n bigint, bad bigint")
    sums = made.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow()
    n, bad = np.zeros(dim + 1, np.int64), np.zeros(dim + 1, np.int64)
    n[sums["word"].to_numpy()], bad[sums["word"].to_numpy()] = sums["n"].to_numpy(), sums["bad"].to_numpy()
    return n[:dim], bad[:dim], int(n[dim]), int(bad[dim])


def telling_words(n: np.ndarray, bad: np.ndarray, rows: int, bad_rows: int) -> np.ndarray:
    """For each word hash its number among the words that tell good and bad rows apart, or -1."""
    rate = bad_rows / max(rows, 1)
    told = (n >= SEEN) & (np.abs(bad - n * rate) >= DISTINCT * np.sqrt(n * rate * (1 - rate)))
    return np.where(told, np.cumsum(told) - 1, -1).astype(np.int32)


def features(docs: DataFrame, place: Column, id_column: str, text_column: str, source: str, lang: str, length: str, numbers: np.ndarray | None = None) -> DataFrame:
    """doc_id, file, row, text_ids, meta_ids: one row per document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytewords.bounded(batches, 0):
            flat, at = text_features(*bytewords.text_buffers(batch.column(0)), numbers)
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, 5)], ids], names=["doc_id", "file", "row", "meta_ids", "text_ids"])

    def hashed(number: int, *values: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(number), *values), F.lit(META_DIM)).cast("int")

    origin, tongue = (F.coalesce(column(docs, c).cast("string"), F.lit("\0")) for c in (source, lang))
    size = F.coalesce(F.floor(F.log2(F.greatest(column(docs, length).cast("double"), F.lit(1.0)))), F.lit(-1).cast("long"))
    meta = F.array(hashed(0, origin), hashed(1, tongue), hashed(2, size), hashed(3, origin, tongue), hashed(4, tongue, size))
    rows = docs.select(
        text_of(docs, text_column).alias("text"), column(docs, id_column).alias("doc_id"),
        place["file"].alias("file"), place["row"].alias("row"), meta.alias("meta_ids"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, file string, row bigint, meta_ids array<int>, text_ids array<int>")


@dataclass
class View:
    """Logistic regression on sets of ids, with a calibration of its log-odds."""

    dim: int
    weights: np.ndarray = field(init=False)
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.weights = np.zeros(self.dim)

    def raw(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids])])
        return total[at[1:]] - total[at[:-1]] + self.bias

    def log_odds_of(self, raw: np.ndarray) -> np.ndarray:
        return self.scale * raw + self.shift

    def log_odds(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.log_odds_of(self.raw(ids, at))

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        (self.scale,), self.shift = logistic(raw[:, None], y)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """A few coefficients by Newton steps, with a little shrinkage so that separable rows stay finite."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (p - y) + l2 * b
        curve = (z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1], float(b[-1])


def _lists(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(array.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def minimiser(size: int, steps: int = STEPS, memory: int = 8) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS from zero: yields the points at which it wants loss and slope, returns the last good one."""
    x = np.zeros(size)
    loss, slope = yield x
    moves: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(steps):
        direction, alphas = slope.copy(), []
        for move, bend in reversed(moves):
            alphas.append((move @ direction) / (move @ bend))
            direction -= alphas[-1] * bend
        if moves:
            move, bend = moves[-1]
            direction *= (move @ bend) / (bend @ bend)
        for (move, bend), alpha in zip(moves, reversed(alphas), strict=True):
            direction += (alpha - (bend @ direction) / (move @ bend)) * move
        fall = slope @ direction
        stride = 1.0 if moves else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-12))
        for _ in range(12):
            at = x - stride * direction
            new_loss, new_slope = yield at
            if new_loss <= loss - 1e-4 * stride * fall:
                break
            stride /= 2
        else:
            break
        if (at - x) @ (new_slope - slope) > 1e-12:
            moves.append((at - x, new_slope - slope))
        gain, x, loss, slope = loss - new_loss, at, new_loss, new_slope
        if gain < 1e-7 * max(abs(loss), 1e-3):
            break
    return x


VIEWS = ("text_ids", "meta_ids")


def _slopes(rows: DataFrame, points: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray]]:
    """Summed loss and slope of both views at ``points`` (weights, then the bias), added up in the tasks.

    A task gives one row a view; the rows to fit on are bounded, and so are their tasks (``PARTS``).
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {v: [0.0, np.zeros(len(x))] for v, x in points.items()}
        for batch in batches:
            y = batch.column("bad").to_numpy().astype(float)
            for v, x in points.items():
                weight = batch.column(f"{v}_weight").to_numpy()
                ids, at = _lists(batch.column(v))
                total = np.concatenate([[0.0], np.cumsum(x[ids])])
                raw = total[at[1:]] - total[at[:-1]] + x[-1]
                sums[v][0] += float((weight * (np.logaddexp(0.0, raw) - y * raw)).sum())
                error = weight * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y)
                sums[v][1][:-1] += np.bincount(ids, np.repeat(error, np.diff(at)), len(x) - 1)
                sums[v][1][-1] += error.sum()
        for v, (loss, slope) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v]), pa.array([loss]), pa.array([slope], pa.list_(pa.float64()))], names=["view", "loss", "slope"])

    columns = [c for v in points for c in (v, f"{v}_weight")]
    found = rows.select("bad", *columns).mapInArrow(add_up, "view string, loss double, slope array<double>").toArrow()
    out = {v: [0.0, np.zeros(len(x))] for v, x in points.items()}
    for view, loss, slope in zip(found["view"].to_pylist(), found["loss"].to_pylist(), found["slope"], strict=True):
        out[view][0] += loss
        out[view][1] += slope.values.to_numpy()
    return {v: (loss, slope) for v, (loss, slope) in out.items()}


def fit_views(views: dict[str, View], rows: DataFrame, l2: float = L2) -> None:
    """Fit both views side by side on stored ``rows`` (bad, ids and weight by view): one job a step; the driver holds coefficients only."""
    total = rows.agg(*[F.sum(f"{v}_weight").alias(v) for v in views]).first()
    learners = {v: minimiser(view.dim + 1) for v, view in views.items()}
    points = {v: next(learner) for v, learner in learners.items()}
    while points:
        asked, points = points, {}
        for v, (loss, slope) in _slopes(rows, asked).items():
            w = asked[v][:-1]
            slope = slope / total[v]
            slope[:-1] += l2 * w
            try:
                points[v] = learners[v].send((loss / total[v] + l2 / 2 * float(w @ w), slope))
            except StopIteration as done:
                views[v].weights, views[v].bias = done.value[:-1], float(done.value[-1])


def raw_values(rows: DataFrame, views: dict[str, View]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Uncalibrated log-odds of both views and the label of a bounded number of rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [pa.array(view.raw(*_lists(batch.column(v)))) for v, view in views.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bad"), *raw], names=["doc_id", "bad", *views])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", f"bad {kinds['bad']}", *[f"{v} double" for v in views]])
    found = rows.select("doc_id", "bad", *views).mapInArrow(score, schema).toArrow().sort_by("doc_id")
    return {v: found[v].to_numpy() for v in views}, found["bad"].to_numpy().astype(float)


def scored(rows: DataFrame, text: View, meta: View) -> DataFrame:
    """``rows`` of features with text_odds and meta_odds, the calibrated log-odds of being bad."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = text.log_odds(*_lists(batch.column(4)))
            m = meta.log_odds(*_lists(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(t), pa.array(m)], names=["doc_id", "file", "row", "text_odds", "meta_odds"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "file", "row", "meta_ids", "text_ids").mapInArrow(score, f"doc_id {kind}, file string, row bigint, text_odds double, meta_odds double")


def _first(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, in the order of a hash: a sample that does not depend on the layout."""
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def one_row_each(docs: DataFrame, place: Column, ids: DataFrame, id_column: str) -> DataFrame:
    """The first row by place of each id in ``ids`` (column _sampled): repeated ids must not lift the bound or outweigh others."""
    at = free_name(docs, "_at")
    kept = docs.select("*", place.alias(at))
    first = (
        kept.select(column(docs, id_column).alias("_sampled"), F.col(at).alias("_first")).join(ids, "_sampled", "left_semi")
        .groupBy("_sampled").agg(F.min("_first").alias("_first"))
    )
    first = F.broadcast(settle(first, "firsts"))
    return kept.join(first, (kept[at]["file"] == first["_first"]["file"]) & (kept[at]["row"] == first["_first"]["row"]), "left_semi").drop(at)


def assess(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    lang_column: str = "lang",
    length_column: str = "n_chars",
    rounds: int = ROUNDS,
    max_labelled: int = MAX_LABELLED,
    max_pseudo: int = MAX_PSEUDO,
    confident: float = CONFIDENT,
) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (chance of being bad), kept, file, row."""
    docs, place = located(docs)
    told = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(
        F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad")
    ).where("doc_id is not null")
    columns = (id_column, text_column, source_column, lang_column, length_column)
    third = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))
    chosen = settle(_first(told, max_labelled).withColumn("held", third == 2), "sample")
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_sampled")))
    few, few_place = located(one_row_each(docs, place, ids, id_column))
    known = features(few, few_place, *columns).join(F.broadcast(chosen.where("not held")), "doc_id")
    numbers = telling_words(*word_counts(known))
    views = {"text_ids": View(SHAPES * SHAPE_BINS + int(numbers.max()) + 1), "meta_ids": View(META_DIM)}
    one = F.lit(1.0)
    labelled = features(few, few_place, *columns, numbers).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "bad", "held", *VIEWS, *[one.alias(f"{v}_weight") for v in VIEWS]
    )
    labelled = settle(labelled.repartition(PARTS), "labelled")
    fit_on, held_out = labelled.where("not held").drop("held"), labelled.where("held")
    n_fit = labelled.agg(
        F.count_if(~F.col("held")).alias("n"), *[F.count_if((F.col("held") == h) & (F.col("bad") == y)).alias(f"h{int(h)}{y}") for h in (False, True) for y in (0, 1)]
    ).first()
    if min(n_fit[c] for c in ("h00", "h01", "h10", "h11")) == 0:
        none = F.lit(None).cast("double")
        return docs.select(
            column(docs, id_column).alias("doc_id"), none.alias("text_score"), none.alias("meta_score"), none.alias("score"),
            F.lit(True).alias("kept"), place["file"].alias("file"), place["row"].alias("row"),
        )
    rows = settle(features(docs, place, *columns, numbers), "features")

    text, meta = views["text_ids"], views["meta_ids"]
    train = fit_on
    for turn in range(rounds + 1):
        fit_views(views, train)
        raw, y = raw_values(held_out, views)
        for v, view in views.items():
            view.calibrate(raw[v], y)
        if turn == rounds:
            break
        sure = float(np.log(confident / (1 - confident)))
        odds = settle(scored(rows, text, meta).where(f"abs(text_odds) >= {sure} or abs(meta_odds) >= {sure}").join(told.select("doc_id"), "doc_id", "left_anti"), "sure")
        train = fit_on
        for by, to in (("text_odds", "meta_ids"), ("meta_odds", "text_ids")):
            halves = [
                _first(odds.where(f"{by} >= {sure}"), max_pseudo // 2), _first(odds.where(f"{by} <= -{sure}"), max_pseudo // 2)
            ]
            picked = settle(halves[0].unionByName(halves[1]).select("file", "row", (F.col(by) > 0).cast("int").alias("bad")), "picked")
            # Pseudo-labels together weigh at most half as much as the labels, so they cannot outvote them.
            weight = min(1.0, PSEUDO_WEIGHT * n_fit["n"] / max(picked.count(), 1))
            given = rows.join(F.broadcast(picked), ["file", "row"]).select(
                "doc_id", "bad", *VIEWS, *[F.lit(weight if v == to else 0.0).alias(f"{v}_weight") for v in VIEWS]
            )
            train = train.unionByName(given)
        train = settle(train.repartition(PARTS), "train")

    mixture, constant = logistic(np.column_stack([v.log_odds_of(raw[n]) for n, v in views.items()]), y)

    def chance(odds: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    together = F.col("text_odds") * float(mixture[0]) + F.col("meta_odds") * float(mixture[1]) + constant
    return scored(rows, text, meta).select(
        "doc_id", chance(F.col("text_odds")).alias("text_score"), chance(F.col("meta_odds")).alias("meta_score"),
        chance(together).alias("score"), (together < 0).alias("kept"), "file", "row",
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected documents, columns unchanged."""
    docs, place = located(docs)
    return without(docs, place, assess(docs, labels, **options).where("not kept"))
