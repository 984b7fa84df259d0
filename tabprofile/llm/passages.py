"""Quality classifier by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of ``WORDS`` words; the last may be shorter.  Every passage
is described by numbers of its form (shares of character kinds, word lengths, repetition),
encoded by a layer ``h = tanh(W x + b)``, and weighed by gated attention

    a = softmax(w . (tanh(V h) * sigmoid(U h)))   over the passages of the document

Only documents carry labels; the weights are learnt from them.  The score is the logistic
function of the weighted mean of h.  The network is fitted by full-batch Adam on at most
``ROWS`` labelled documents of each class (their passages' numbers come to the driver, not
their texts); scoring is one pass over whole texts without a shuffle.

Defined results: null and word-less texts are one passage of zeros and get its score; a
document's score depends on its text alone, so repeated rows get the same score and null
ids one each; without labels of both classes every score is 0.5; an empty table gives an
empty result; other columns are ignored or carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import remainder, slices
from tabprofile.llm.labelled import sample

WORDS = 40
ROWS = {0: 1000, 1: 1500}
PARTS, HELD = 4, 2
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#*$%&", b"|<>{}[]\\/=_~^@+`"]
FEATURES = len(KINDS) + 2 + 11  # other ASCII and bytes beyond it are kinds, too
FLUSH = 20_000  # words described at a time
HIDDEN, GATES, STEPS, RATE, DECAY = 16, 8, 150, 0.03, 1e-4


def describe(bags: list[list[list[bytes]]]):
    """One row of numbers for each passage of each bag; a passage is a list of words."""
    import numpy as np
    table = np.full(256, len(KINDS), np.int64)
    table[128:] = len(KINDS) + 1
    for k, chars in enumerate(KINDS):
        table[list(chars)] = k
    kinds = len(KINDS) + 2
    passages = [p for bag in bags for p in bag]
    n = np.array([len(p) for p in passages])
    words = [w for p in passages for w in p]
    out = np.zeros((len(passages), FEATURES))
    if not words:
        return out
    size = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(passages)), n)
    data = np.frombuffer(b"".join(words), np.uint8)
    of_byte = np.repeat(of, size)
    chars = np.bincount(of_byte * kinds + table[data], minlength=len(passages) * kinds).reshape(-1, kinds)
    total = np.maximum(chars.sum(axis=1, keepdims=True), 1)
    out[:, :kinds] = chars / total
    some = np.maximum(n, 1)

    def share(flags):
        return np.bincount(of, flags, len(passages)) / some

    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    keys, counts = np.unique(of * len(known) + ids, return_counts=True)
    of_key = keys // len(known)
    most = np.zeros(len(passages))
    np.maximum.at(most, of_key, counts)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    first, last = table[data[starts]], data[starts + size - 1]
    upper = np.add.reduceat((table[data] == 1).astype(np.int64), starts)
    mean = np.bincount(of, size, len(passages)) / some
    more = [n / WORDS, mean / 10, np.sqrt(np.maximum(np.bincount(of, size * size, len(passages)) / some - mean**2, 0)) / 10,
            np.bincount(of_key, minlength=len(passages)) / some, most / some,
            share(np.concatenate([[False], (ids[1:] == ids[:-1]) & (of[1:] == of[:-1])])),
            share(first == 1), share((upper == size) & (size > 1)), share(last == ord(".")), share(size <= 3),
            share((first >= 5) & (first <= 6) & (size == 1))]
    out[:, kinds:] = np.stack(more, axis=1)
    return out


def described(texts: list[str]):
    """(numbers of all passages, passages of each text); long texts in parts."""
    import numpy as np
    parts, counts, bags, held = [], [], [], 0
    for t in texts:
        words = t.encode().split()
        own = [words[i:i + WORDS] for i in range(0, len(words), WORDS)] or [[]]
        counts.append(len(own))
        for i in range(0, len(own), FLUSH // WORDS):
            bags.append(own[i:i + FLUSH // WORDS])
            held += len(bags[-1]) * WORDS
            if held >= FLUSH:
                parts.append(describe(bags))
                bags, held = [], 0
    if bags:
        parts.append(describe(bags))
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES)), np.array(counts, np.int64)


def forward(model: dict, x, counts):
    """Scores of the bags and what training needs of the way there."""
    import numpy as np
    starts, of = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.repeat(np.arange(len(counts)), counts)
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    s = (t * g) @ model["w"]
    e = np.exp(s - np.maximum.reduceat(s, starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(a[:, None] * h, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ model["c"] + model["c0"], -30, 30)))
    return p, (starts, of, h, t, g, a, z)


def fit(x, counts, y, seed: int = 7) -> dict:
    """The network for passages ``x``, ``counts`` of them a document, and labels ``y``."""
    import numpy as np
    r = np.random.default_rng(seed)
    model = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3,
             "W": r.normal(0, x.shape[1]**-0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
             "V": r.normal(0, 0.3, (HIDDEN, GATES)), "U": r.normal(0, 0.3, (HIDDEN, GATES)), "w": r.normal(0, 0.3, GATES),
             "c": r.normal(0, 0.3, HIDDEN), "c0": np.zeros(())}
    learnt = ["W", "b", "V", "U", "w", "c", "c0"]
    first, second = ({k: np.zeros_like(model[k]) for k in learnt} for _ in range(2))
    scaled = (x - model["mean"]) / model["scale"]
    for step in range(1, STEPS + 1):
        p, (starts, of, h, t, g, a, z) = forward(model, x, counts)
        d = (p - y) / len(y)
        dz = d[:, None] * model["c"]
        along = (h * dz[of]).sum(axis=1)
        ds = a * (along - np.add.reduceat(a * along, starts)[of])
        gate = ds[:, None] * model["w"]
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        pre = (a[:, None] * dz[of] + dt @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
        grad = {"W": scaled.T @ pre, "b": pre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds,
                "c": z.T @ d, "c0": d.sum()}
        for k in learnt:
            full = grad[k] + DECAY * model[k]
            first[k] = 0.9 * first[k] + 0.1 * full
            second[k] = 0.999 * second[k] + 0.001 * full * full
            model[k] = model[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: dict[int, int] = ROWS,
          parts: int = PARTS, held: int = HELD) -> dict | None:
    """The network, or None without labels of both classes."""
    import numpy as np

    def task(batches):
        import pyarrow as pa
        for batch in batches:
            for b in slices(batch):
                x, counts = described(b.column(1).to_pylist())
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(2), pa.array([x[z - n:z].astype("<f4").tobytes() for n, z in zip(counts, ends)], pa.binary())],
                    ["label", "x"])

    found = sample(docs, labels, label, rows, parts, held).mapInArrow(task, "label int, x binary").toArrow()
    both = sorted(zip(found["x"].to_pylist(), found["label"].to_pylist()))  # no matter in which order tasks end
    y = np.array([k for _, k in both], float)
    if len(set(y)) < 2:
        return None
    x = np.concatenate([np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b, _ in both]).astype(float)
    return fit(x, np.array([len(b) // (4 * FEATURES) for b, _ in both]), y)


def scored(docs: DataFrame, model: dict | None, carry) -> DataFrame:
    """carry and score of every row."""
    rows = docs.select(carry.alias("carry"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select("carry", F.lit(0.5).alias("score"))

    def task(batches):
        import pyarrow as pa
        for batch in batches:
            for b in slices(batch):
                if b.num_rows:
                    p, _ = forward(model, *described(b.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["carry", "score"])

    return rows.mapInArrow(task, f"carry {rows.schema['carry'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = scored(docs, train(docs, labels), F.struct("doc_id")).select("carry.doc_id", "score")
    return rows.select("doc_id", (remainder("doc_id", PARTS) == HELD).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``docs`` without rows that score below ``threshold``, all columns as they were; all rows
    without labels of both classes, as nothing is known against any."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    narrow = plain.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"),
                          F.struct(*[f"c{i}" for i in range(len(names))]).alias("all"))
    model = train(narrow, labels)
    if model is None:
        return docs
    rows = scored(narrow, model, F.col("all"))
    return rows.where(F.col("score") >= threshold).select("carry.*").toDF(*names)
