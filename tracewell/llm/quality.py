"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are mapped to random Fourier features, which approximate a Gaussian kernel, and a constant; the
statistics themselves are no features. Each partition sums its part of the normal equations; the sums meet by matrix row
in two levels, so no task or driver sees a row a document or a vector a partition at once. The ridge solution's raw scores
are calibrated on labels apart from those that fit it: counts in fixed score bins, summed alike, give an isotonic curve.
Every labelled row counts; there is no sample.

Cases: null text counts as empty and is scored like any; a text of any length is read whole; a null doc_id counts as held
out; a document with several labels counts with each; rows with a null label are left out of the fit; documents with equal
texts have equal scores, and a score at the threshold is accepted; without labels every score is 0.5; an empty table gives
an empty result; further columns are ignored by score() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SUBS, configure, drop_materialized, materialize, sum_vectors, text_or_empty

#: Document statistics, in order.
STATISTICS = [
    "log_chars", "log_words", "word_chars", "word_spread", "distinct_words", "top_word", "upper", "digit", "space", "stop_marks",
    "loud_marks", "symbols", "markup", "other_bytes", "line_words", "distinct_lines", "repeated_line_chars", "long_words", "byte_entropy", "pair_variety", "upper_starts", "mark_ends", "doubled_words",
]
WAVES = 224
BINS = 1024
SEED = 3


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    import numpy as np

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), "uint8")
    n = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    part = lambda chars: float(count[list(chars)].sum()) / n
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), "float64", len(words)) if words else np.zeros(1)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    distinct_lines = set(lines)
    line_chars = max(1, sum(map(len, lines)))
    p = count[count > 0] / n
    pairs = len(np.unique(raw[:-1].astype("uint16") * 256 + raw[1:])) if len(raw) > 1 else 1
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(min(40, lengths.mean())), float(min(40, lengths.std())),
        len(tally) / k, max(tally.values(), default=0) / k, part(range(65, 91)), part(range(48, 58)), part((9, 10, 13, 32)), part(b".,;:"),
        part(b"!?"), part(b"#$%&*@^~|+="), part(b"<>{}[]\\/_"), float(count[128:].sum()) / n, float(np.log1p(len(words) / max(1, len(lines)))),
        len(distinct_lines) / max(1, len(lines)), 1 - sum(map(len, distinct_lines)) / line_chars, float((lengths > 20).mean()),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, pairs / float(np.sqrt(n) * 16), sum(w[0].isupper() for w in words) / k, sum(w[-1] in ".,!?" for w in words) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
    ]


def waves(x, mean, scale):
    """Random Fourier features of the scaled statistics, and a constant."""
    import numpy as np

    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((z.shape[1], WAVES)) / np.sqrt(z.shape[1])
    phase = rng.random(WAVES) * 2 * np.pi
    return np.hstack([np.sqrt(2 / WAVES) * np.cos(z @ w + phase), np.ones((len(z), 1))])


def describe(docs: DataFrame) -> DataFrame:
    """The documents with their statistics as a vector of doubles in a further last column."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    at, name = docs.columns.index("text"), "statistics"
    while name in docs.columns:
        name += "_"

    def rows(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = pa.array([statistics(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(rows, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def fold(doc_id="doc_id"):
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def _sums(parts: DataFrame) -> dict:
    """Vectors of doubles added up by key, on the driver; as many keys as the model has rows."""
    import numpy as np

    return {r["at"]: np.frombuffer(r["v"]) for r in sum_vectors(parts, "f8").collect()}


def _rows_of(matrix):
    """A batch of a task's part of a sum, by row."""
    import pyarrow as pa
    from pyspark import TaskContext

    sub = TaskContext.get().partitionId() % SUBS
    n = len(matrix)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([sub] * n, pa.int32()),
        pa.array([r.tobytes() for r in matrix], pa.binary())], names=["at", "sub", "v"])


PART = "at int, sub int, v binary"


def fit(described: DataFrame, labels: DataFrame, ridge: float = 1e-2) -> dict | None:
    """The model from (doc_id, x) and (doc_id, quality): folds 1 to 3 fit, fold 4 calibrates, fold 0 is never seen."""
    import numpy as np

    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y"))
    train = materialize(described.join(known, "doc_id").select("x", "y", fold().alias("fold")).where("fold != 0"), "train")
    d = len(STATISTICS)
    first = train.select([F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.count("*").alias("n")]).first()
    if not first["n"]:
        return None
    mean, scale = np.array([first[f"m{i}"] for i in range(d)]), np.array([max(1e-6, first[f"s{i}"]) for i in range(d)])

    def equations(batches) -> Iterator:
        import numpy as np

        total = None
        for batch in batches:
            z = waves(np.array(batch.column(0).to_pylist()), mean, scale) if batch.num_rows else None
            if z is not None:
                both = np.hstack([z, batch.column(1).to_numpy()[:, None]])
                total = both.T @ both if total is None else total + both.T @ both
        if total is not None:
            yield _rows_of(total)

    rows = _sums(train.where("fold < 4").select("x", "y").mapInArrow(equations, PART))
    if not rows:
        return None
    total = np.array([rows[i] for i in range(len(rows))])
    a, b = total[:-1, :-1], total[:-1, -1]
    model = {"mean": mean, "scale": scale, "beta": np.linalg.solve(a + ridge * max(1.0, total[-2, -2]) * np.eye(len(a)) / len(a), b)}

    def bins(batches) -> Iterator:
        import numpy as np

        total = np.zeros((2, BINS))
        for batch in batches:
            if batch.num_rows:
                k = _bin(raw(model, np.array(batch.column(0).to_pylist())))
                total += [np.bincount(k, minlength=BINS), np.bincount(k, batch.column(1).to_numpy(), BINS)]
        yield _rows_of(total)

    seen = _sums(train.where("fold = 4").select("x", "y").mapInArrow(bins, PART))
    drop_materialized(labels.sparkSession, train)
    return model | {"curve": isotonic(seen.get(0, np.zeros(BINS)), seen.get(1, np.zeros(BINS)))}


def raw(model: dict, x):
    """Ridge scores before calibration."""
    return waves(x, model["mean"], model["scale"]) @ model["beta"]


def _bin(scores):
    import numpy as np

    return np.clip(((scores + 0.5) / 2 * BINS).astype("int64"), 0, BINS - 1)


def isotonic(n, hits) -> tuple:
    """Pool adjacent violators over score bins: (centres, values); one prior count of each class keeps values inside (0, 1)."""
    import numpy as np

    blocks: list[list[float]] = []
    for i in np.nonzero(n)[0]:
        blocks.append([float(hits[i]), float(n[i]), i * float(n[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    centres = np.array([((c / m) + 0.5) / BINS * 2 - 0.5 for _, m, c in blocks])
    return centres, np.maximum.accumulate([(h + 0.5) / (m + 1) for h, m, _ in blocks])


def apply(model: dict | None, x):
    """Calibrated scores; a slight slope keeps the order within flat parts of the curve."""
    import numpy as np

    if model is None:
        return np.full(len(x), 0.5)
    r = raw(model, x)
    return np.clip(0.999 * np.interp(r, *model["curve"]) + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    configure(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    described = materialize(describe(plain).drop("text").toDF("doc_id", "x"), "statistics")
    model = fit(described, labels)

    def rows(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(apply(model, x), pa.float64())], names=["doc_id", "score"])

    scored = described.mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. Statistics are made once and written beside them."""
    configure(docs.sparkSession)
    described = materialize(describe(docs), "statistics")
    model = fit(described.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(described.columns[-1]).alias("x")), labels)
    n = len(docs.columns)

    def rows(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(apply(model, x) >= threshold))

    return described.mapInArrow(rows, docs.schema)
