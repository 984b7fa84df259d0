"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two bigram models, of toxic and of ordinary documents, both interpolated:

    P(w | u) = max(N(. u w) - D, 0) / N(. u .) + g(u) * P(w)
    P(w)     = max(N(. w) - D, 0) / N          + b    * S(w)

Both levels use Kneser-Ney's continuation counts: N(. u w) is the number of different words
before the bigram, N(. w) that before the word, so passages that are copied or repeated
count once.  g(u) and b are the shares that the discount D takes away.  S(w) is the backoff both classes share, from their joint counts
of different words before w, with one added; so an expression that is too rare to tell the
classes apart is as likely in either.

The log-likelihood ratio, within ``BOUND`` a word, is normalised by length in every window
of ``WINDOWS`` words, as a few toxic words would vanish in the mean of a long text; the
score is the logistic function of the mean ratios of the highest windows, of the ``HIGHEST``
highest words wherever they stand (one rare word happens in an ordinary text, several hardly),
and of the whole text, and of the length's logarithm, as high ratios happen more in long texts.  That function is fitted on one
half of the sampled documents, scored by models of the other half, and so is D, the one of
``DISCOUNTS`` with the least loss; the final models are of both.  Halves are by a hash of the id,
and by its order within a class whose documents would all be in one half (:func:`halves`);
where a half still has no words of a class, as with a single document of it, D is the first of
``DISCOUNTS`` and the function is fitted on the documents the models are of.  The sample has at most ``ROWS`` labelled documents of each class, so the models
are bounded; it takes four ordinary documents for a toxic one, as with fewer the words of less
common languages happen in the toxic sample alone; they go to all tasks as sorted arrays of word hashes, and scoring is one pass
over whole texts without a shuffle.

Words are runs of non-white characters with A-Z lower-cased and ASCII punctuation taken
as white space.  Defined results: null, empty and word-less texts have ratio zero; a score
depends on the text alone, so repeated rows get the same score and null ids one each;
without labelled words of both classes every score is 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import remainder, slices, stored, texts
from tabprofile.llm.labelled import sample

ROWS = {0: 8000, 1: 2000}
DISCOUNTS = (1.0, 1.5, 3.0, 4.0, 6.0)  # none below 1, see ``tables``
PARTS, HELD = 3, 1
WINDOWS = (1, 3, 6)
HIGHEST = (4, 8)
FEATURES = len(WINDOWS) + len(HIGHEST) + 2
BOUND = 5.0
START = 1  # hash that stands for the start of a text
PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


class Hasher:
    """Words of a text as 64-bit hashes, with a bounded cache."""

    def __init__(self):
        self.cache = {}

    def __call__(self, text: str):
        import numpy as np
        from xxhash import xxh64_intdigest
        cache = self.cache
        if len(cache) > 400_000:
            cache.clear()
        words = text.encode().lower().translate(PUNCTUATION).split()
        for w in set(words).difference(cache):
            cache[w] = xxh64_intdigest(w)
        return np.array([cache[w] for w in words], np.uint64)


def pair_key(u, w):
    import numpy as np
    return u * np.uint64(0x9E3779B97F4A7C15) + w


def halves(chosen: DataFrame) -> DataFrame:
    """``chosen`` with half, 0 or 1; a class of two documents or more is in both."""
    h = F.xxhash64("doc_id", F.lit("half"))
    half = F.pmod(h, F.lit(2)).cast("int")
    for label, found in chosen.groupBy("label").agg(F.collect_list(h)).collect():  # at most ROWS numbers
        found.sort()
        if len(found) > 1 and len({x % 2 for x in found}) == 1:
            half = F.when(F.col("label") == label, (h >= found[len(found) // 2]).cast("int")).otherwise(half)
    return chosen.withColumn("half", half)


def bigram_counts(rows: DataFrame) -> DataFrame:
    """label, u, w (hashes as signed numbers), c (different words before the bigram) and c0
    (of those, the ones in half 0): from text, label, half."""
    def task(batches):
        import numpy as np
        import pyarrow as pa
        hasher, start = Hasher(), np.array([START, START], np.uint64)
        for batch in batches:
            for b in slices(batch):
                for text, label, half in zip(*[b.column(i).to_pylist() for i in range(3)]):
                    words = np.concatenate([start, hasher(text)])
                    found = np.unique(np.stack([words[:-2], words[1:-1], words[2:]], axis=1), axis=0).view(np.int64)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([half] * n, pa.int32()), pa.array([label] * n, pa.int32()),
                         *[pa.array(found[:, i]) for i in range(3)]], ["half", "label", "v", "u", "w"])

    return rows.select("text", "label", "half").mapInArrow(task, "half int, label int, v long, u long, w long") \
        .groupBy("label", "u", "w", "v").agg(F.min("half").alias("half")) \
        .groupBy("label", "u", "w").agg(F.count(F.lit(1)).alias("c"), F.sum(1 - F.col("half")).alias("c0"))


def tables(counts: DataFrame, column: str, discounts=None) -> dict:
    """What the models of ``counts`` (label, u, w and ``column``, the bigram's count) need, as
    arrays: ``pairs`` (u, w, and the counts n0, n1 of both classes), ``contexts`` (u, their
    totals o0, o1, and for each discount the sums t0_i, t1_i of what it takes), ``words`` (w,
    different words before it in either class, j, and in each, b0 and b1) and ``sums``.

    Sums and totals are added up by Spark over all bigrams.  As no discount is below 1, bigrams
    that neither class counts twice, and contexts and words of these alone, are
    backed off alike in both; they stay behind."""
    def of(label):
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col(column))), F.lit(0))

    merged = counts.where(F.col(column) > 0).groupBy("u", "w").agg(of(0).alias("n0"), of(1).alias("n1"))
    most = F.max(F.greatest("n0", "n1")).alias("most")

    def taken(c, name):
        return [F.sum(F.least(F.col(c).cast("double"), F.lit(float(d)))).alias(f"{name}_{i}") for i, d in enumerate(discounts or DISCOUNTS)]

    words = merged.groupBy("w").agg(F.count(F.lit(1)).alias("j"), F.count_if(F.col("n0") > 0).alias("b0"), F.count_if(F.col("n1") > 0).alias("b1"), most)
    contexts = merged.groupBy("u").agg(F.sum("n0").alias("o0"), F.sum("n1").alias("o1"), *taken("n0", "t0"), *taken("n1", "t1"), most)
    sums = words.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("j", "b0", "b1")],
                     *taken("b0", "t0"), *taken("b1", "t1")).first().asDict()

    def arrays(df, *keys):
        import numpy as np
        found = df.toArrow()
        out = {f: found[f].to_numpy() for f in found.column_names}
        out.update({k: out[k].view(np.uint64) for k in keys})
        order = np.lexsort([out[k] for k in reversed(keys)])  # no matter in which order tasks end
        return {f: x[order] for f, x in out.items()}

    return {"sums": sums, "pairs": arrays(merged.where("n0 > 1 or n1 > 1"), "u", "w"), "contexts": arrays(contexts.where("most > 1").drop("most"), "u"),
            "words": arrays(words.where("b0 > 1 or b1 > 1 or most > 1").drop("most"), "w")}


def ratios(found: dict, i: int, d: float) -> dict:
    """Sorted tables of log-likelihood ratios (toxic over ordinary) from ``tables``, for its
    i-th discount ``d``."""
    import numpy as np
    sums, words, contexts, pairs = (found[k] for k in ("sums", "words", "contexts", "pairs"))
    total = sums["j"] + sums["v"] + 1.0  # one for each word, and one for words never seen
    pair_w, pair_u = np.searchsorted(words["w"], pairs["w"]), np.searchsorted(contexts["u"], pairs["u"])
    uni, gamma, bi, unknown = [], [], [], []
    for k in "01":
        before = words[f"b{k}"].astype(float)
        back = sums[f"t{k}_{i}"] / sums[f"b{k}"]
        p = np.maximum(before - d, 0) / sums[f"b{k}"] + back * (words["j"] + 1.0) / total
        of_context = contexts[f"o{k}"].astype(float)
        g = np.where(of_context > 0, contexts[f"t{k}_{i}"] / np.maximum(of_context, 1), 1.0)
        uni.append(p)
        unknown.append(back / total)
        gamma.append(g)
        bi.append(np.maximum(pairs[f"n{k}"] - d, 0) / np.maximum(of_context, 1)[pair_u] + g[pair_u] * p[pair_w])

    # what no class counts more than d times is backed off in both: its ratio is the default
    def kept(keys, values, default):
        some = np.abs(values - default) > 1e-9
        return keys[some], values[some].astype(np.float32)

    base = float(np.log(unknown[1] / unknown[0]))
    uni, gamma, bi = (np.log(x[1] / x[0]) for x in (uni, gamma, bi))
    known = pair_key(pairs["u"], pairs["w"])
    order = np.argsort(known)
    known, bi, backed = known[order], bi[order], (uni[pair_w] + gamma[pair_u])[order]
    kept_words, kept_pairs = kept(words["w"], uni, base), kept(known, bi, backed)
    kept_contexts = kept(contexts["u"], gamma, 0.0)
    return {"words": kept_words[0], "uni": kept_words[1], "contexts": kept_contexts[0], "gamma": kept_contexts[1], "pairs": kept_pairs[0],
            "bi": kept_pairs[1], "unknown": base}


def lookup(keys, values, wanted, other: float):
    import numpy as np
    if not len(keys):
        return np.full(len(wanted), np.float32(other)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(other)), keys[at] == wanted


def text_ratios(model: dict, hashes: list):
    """Of each text: the highest mean log-likelihood ratio of windows of each size, the mean of
    its highest words' ratios, the logarithm of its length, and the whole mean."""
    import numpy as np
    out = np.zeros((len(hashes), FEATURES))
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    w = np.concatenate([hashes[i] for i in full])
    u = np.concatenate([np.concatenate([np.array([START], np.uint64), hashes[i][:-1]]) for i in full])
    seen, is_seen = lookup(model["pairs"], model["bi"], pair_key(u, w), 0)
    backed = lookup(model["words"], model["uni"], w, model["unknown"])[0] + lookup(model["contexts"], model["gamma"], u, 0)[0]
    llr = np.clip(np.where(is_seen, seen, backed).astype(float), -BOUND, BOUND)
    at = 0
    for i in full:
        n = len(hashes[i])
        sums = np.concatenate([[0.0], np.cumsum(llr[at:at + n])])
        for j, span in enumerate(WINDOWS):
            out[i, j] = (sums[min(span, n):] - sums[:n + 1 - min(span, n)]).max() / span
        own = llr[at:at + n]
        for j, k in enumerate(HIGHEST, len(WINDOWS)):
            out[i, j] = (own if n <= k else np.partition(own, n - k)[n - k:]).sum() / k
        out[i, -2], out[i, -1] = np.log(n), sums[-1] / n
        at += n
    return out


def logistic(x, y, rounds: int = 50):
    """Weights (the constant last) of a slightly damped logistic regression, by Newton's method."""
    import numpy as np
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b)), x.T @ (y - p) - 0.05 * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return b


def measured(rows: DataFrame, models: list[dict], *kept: str) -> DataFrame:
    """``kept`` columns and ratios: ``text_ratios`` by each model in turn, one array."""
    bc = rows.sparkSession.sparkContext.broadcast(models)
    source = rows.select(*kept, "text")

    def task(batches):
        import numpy as np
        import pyarrow as pa
        hasher = Hasher()
        for batch in batches:
            for b in slices(batch):
                hashes = [hasher(t) for t in b.column(b.num_columns - 1).to_pylist()]
                found = np.concatenate([text_ratios(m, hashes) for m in bc.value], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.tolist(), pa.list_(pa.float64()))], [*kept, "ratios"])

    schema = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in kept)
    return source.mapInArrow(task, f"{schema}, ratios array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: dict[int, int] = ROWS,
          parts: int = PARTS, held: int = HELD) -> tuple[dict, list[float]] | None:
    """(models' ratio tables, weights of the logistic function), or None without
    words of both classes."""
    import numpy as np
    chosen = halves(sample(docs, labels, label, rows, parts, held))
    counts = stored(bigram_counts(chosen), "bigrams")  # several sums are made of them
    whole = tables(counts, "c")
    if not (whole["sums"]["b0"] and whole["sums"]["b1"]):
        return None
    half, tried, seen = tables(counts, "c0"), DISCOUNTS, []
    if half["sums"]["b0"] and half["sums"]["b1"]:
        trials = [ratios(half, i, d) for i, d in enumerate(tried)]
        seen = sorted((r["ratios"], r["label"]) for r in measured(chosen.where("half = 1"), trials, "label").collect())
    if len({y for _, y in seen}) < 2:
        tried = DISCOUNTS[:1]
        seen = sorted((r["ratios"], r["label"]) for r in measured(chosen, [ratios(whole, 0, tried[0])], "label").collect())
    y, found = np.array([y for _, y in seen]), np.array([r for r, _ in seen])
    fitted, width = [], FEATURES
    for i, d in enumerate(tried):
        x = found[:, i * width:(i + 1) * width]
        weights = logistic(x, y)
        z = np.clip(np.column_stack([x, np.ones(len(x))]) @ weights, -30, 30)
        fitted.append((float((np.log1p(np.exp(z)) - y * z).mean()), d, weights.tolist()))
    _, d, weights = min(fitted)
    return ratios(whole, DISCOUNTS.index(d), d), weights


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = texts(docs)
    trained = train(docs, labels)
    if trained is None:
        rows = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        model, (*weights, base) = trained
        z = sum((F.col("ratios")[i] * F.lit(x) for i, x in enumerate(weights)), F.lit(base))
        rows = measured(rows, [model], "doc_id").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return rows.select("doc_id", (remainder("doc_id", PARTS) == HELD).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
