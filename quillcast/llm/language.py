"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte 3-grams and 4-grams of lower-cased words with a blank on either side. Each is hashed
to a row of an embedding table; a text is the average of its rows; a linear layer and a softmax follow.
The model is trained on the driver in numpy by stochastic gradient descent on a bounded sample, then its
temperature and a threshold of rejection are set on a part of the sample that it has not seen. Since the
layer is linear, prediction adds up one row of class scores for each subword, for whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import keep, table
from quillcast.llm.text_arrays import LOWER, slices, text_buffers

ROWS = 1 << 15
#: Documents of the sample for each language, width of embeddings, epochs, rate, characters of a training piece.
SAMPLE, WIDTH, EPOCHS, RATE, PIECE = 400, 16, 6, 0.5, 256
#: Characters that the sample takes of one document.
LONGEST = 1 << 14
#: Share of the held-back part whose predictions are kept by the rejection threshold.
KEPT = 0.99

_SPACE = np.zeros(256, bool)
_SPACE[[b for b in range(0x80) if not (0x30 <= b < 0x3A or 0x41 <= b < 0x5B or 0x61 <= b < 0x7B)]] = True


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, table row) of all 3-grams and 4-grams of bytes; signs and blanks count as one blank."""
    b = np.where(_SPACE[data], np.uint8(0x20), LOWER[data]).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    three = (b[:-3] << np.uint32(16)) | (b[1:-2] << np.uint32(8)) | b[2:-1]
    four = (three << np.uint32(8)) | b[3:]
    digits = (data >= 0x30) & (data < 0x3A)
    inner = ~((b[1:-2] == 0x20) | digits[1:-2])
    at = np.flatnonzero(inner)
    # A multiplicative hash; its high bits choose the row.
    x = (three[at] * np.uint32(2654435761)) >> np.uint32(17)
    at4 = np.flatnonzero(inner & (b[2:-1] != 0x20))
    y = ((four[at4] ^ (four[at4] >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(17)
    return np.concatenate([at, at4]), np.concatenate([x, y]).astype(np.int64)


def class_sums(col: pa.Array, scores: np.ndarray):
    """For slices of a column: first row, averaged class scores, and number of subwords of each text."""
    data, offs = text_buffers(col)
    for lo, hi in slices(offs):
        n, k = hi - lo, scores.shape[1]
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        # Texts are parted by blanks, so that no subword reaches into the next one.
        gap = np.arange(n, dtype=np.int64) * 4
        wide = np.full(len(part) + 4 * n + 4, 0x20, np.uint8)
        wide[np.arange(len(part)) + np.repeat(gap + 1, np.diff(o))] = part
        begins = o[:-1] + gap
        at, row = subwords(wide)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        first = np.searchsorted(at, np.append(begins, len(wide)))
        count = np.diff(first)
        sums = np.zeros((n, k))
        full = np.flatnonzero(count)
        if len(full):
            for c in range(k):
                sums[full, c] = np.add.reduceat(scores[:, c][row], first[full])
        yield lo, hi, sums / np.maximum(count, 1)[:, None], count


class Model:
    """Learned languages, class scores of each table row (embedding times layer), bias, temperature, threshold."""

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.scores, self.bias, self.temperature, self.threshold = langs, scores, bias, temperature, threshold

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit a model; one fifth of the texts sets temperature and threshold. No texts give a model without languages."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((ROWS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    y_of = {x: k for k, x in enumerate(langs)}
    train_x, train_y, held = [], [], []
    for k, (t, lang) in enumerate(zip(texts, labels)):
        data = np.frombuffer(f" {t} ".encode(), np.uint8)
        if k % 5 == 4:
            held.append((t, y_of[lang]))
            continue
        for at in range(0, len(data), PIECE):
            row = subwords(data[at : at + PIECE])[1]
            if len(row):
                train_x.append(row)
                train_y.append(y_of[lang])
    emb = rng.normal(0, 0.1, (ROWS, WIDTH))
    layer, bias = rng.normal(0, 0.3, (WIDTH, len(langs))), np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(train_x)).tolist():
            row = train_x[k]
            h = emb[row].mean(axis=0)
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[train_y[k]] -= 1
            back = layer @ p
            layer -= rate * np.outer(h, p)
            bias -= rate * p
            np.subtract.at(emb, row, rate * back / len(row) * 8)
    model = Model(langs, (emb @ layer).astype(np.float32), bias)
    if held:
        y = np.array([h[1] for h in held])
        mean = np.concatenate([m for _, _, m, _ in class_sums(pa.array([h[0] for h in held]), model.scores)])
        loss = {}
        for temperature in np.geomspace(0.05, 10, 40):
            model.temperature = float(temperature)
            loss[model.temperature] = -np.log(model.probabilities(mean)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = min(loss, key=loss.get)
        model.threshold = float(np.quantile(model.probabilities(mean).max(axis=1), 1 - KEPT))
    return model


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def excerpt(text: Column, longest: int = LONGEST, pieces: int = 16) -> Column:
    """A text of at most `longest` characters as it is; of a longer one pieces that lie evenly over the whole of it."""
    one = longest // pieces - 1
    at = lambda k: ((F.length(text) - one) * k / (pieces - 1)).cast("int") + 1
    return F.when(F.length(text) <= longest, text).otherwise(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring(text, at(k), F.lit(one)))))


def sample(docs: DataFrame, size: int = SAMPLE) -> list:
    """At most `size` rows (text, lang) of each language, the documents with the least hash in each of `size` slots.

    The driver gets no more than LONGEST characters of one: of longer texts, pieces from all over them (see excerpt()).
    The slots are filled by a partial aggregate, so no language is gathered in one task. A language without
    a text that has letters isn't learned."""
    able = docs.filter((fold() != 1) & F.col("lang").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    h = F.xxhash64("doc_id", F.lit("language"))
    slots = able.groupBy("lang", F.pmod(h, F.lit(size)).alias("slot")).agg(F.min_by("doc_id", h).alias("doc_id"))
    chosen = keep(slots.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "chosen")
    # Bounded: `size` rows for each language.
    rows = able.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return sorted(rows.select("doc_id", "lang", excerpt(F.col("text")).alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["doc_id"], r["lang"]))


def _predict(held):
    def run(batches):
        model = held.value
        for batch in batches:
            names = batch.schema.names
            col = batch.column(names.index("text"))
            able = batch.column(names.index("_letters"))
            for lo, hi, mean, _ in class_sums(col, model.scores):
                p = model.probabilities(mean)
                best, ok = p.argmax(axis=1), able.slice(lo, hi - lo).to_pylist()
                ok = [x and bool(model.langs) for x in ok]
                pred = pa.array([model.langs[b] if x else "und" for b, x in zip(best.tolist(), ok)], pa.string())
                score = pa.array([float(s) if x else 0.0 for s, x in zip(p.max(axis=1), ok)], pa.float64())
                no = pa.array([not x or s < model.threshold for s, x in zip(p.max(axis=1).tolist(), ok)], pa.bool_())
                own = [batch.column(k).slice(lo, hi - lo) for k, n in enumerate(names) if n not in ("text", "_letters")]
                yield pa.RecordBatch.from_arrays([*own, pred, score, no], names=[*(n for n in names if n not in ("text", "_letters")), "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """`keys` of docs, lang_pred, score (0 to 1) and rejected for every row, from its whole text only.

    A null text or one without a letter is `und` with score 0 and rejected; so is any text if nothing was
    learned. rejected marks predictions below the calibrated threshold; lang_pred stays."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(*keys, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), "lang_pred string, score double, rejected boolean"])
    return rows.mapInArrow(_predict(held), schema)


def op4_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = sample(docs)
    model = train([r["text"] for r in rows], [r["lang"] for r in rows])
    found = identify(docs, model, "doc_id")
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
