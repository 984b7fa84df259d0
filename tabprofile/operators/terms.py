"""D-j: frequent terms of a text column, without shuffling its vocabulary.

A term is a run of non-white characters, A-Z in lower case.  In a first pass every task keeps a
summary of at most ``capacity`` terms (Misra and Gries): when it holds more, the count of
the next largest is taken off all, and what reaches zero goes.  A kept count is at most the true
one, and short of it by no more than what was taken off, so summaries of all tasks
add up: any term's count lies between its summed count and that plus the summed error, which is
at most all words / capacity.  The terms that may so be among the ``k`` most frequent are
counted exactly in a second pass, again a bounded table a task.  If a term outside all summaries
could be among them, the first pass is repeated with four times the capacity, so the result
is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.roles import qcol
from tabprofile.sources.sinks import shared_table

CAPACITY = 4096
CANDIDATES = 100_000  # most terms that are broadcast for the exact count


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: ASCII letters and white space alone


def summary(batches, capacity: int):
    """(counts of at most ``capacity`` terms, what was taken off) of an iterator of texts lists."""
    from collections import Counter
    held, error = Counter(), 0
    for texts in batches:
        for t in texts:
            held.update(_words(t))
            if len(held) > 4 * capacity:
                held, error = pruned(held, error, capacity)
    return pruned(held, error, capacity)


def pruned(held, error: int, capacity: int):
    from collections import Counter
    if len(held) <= capacity:
        return held, error
    off = sorted(held.values(), reverse=True)[capacity]
    return Counter({w: c - off for w, c in held.items() if c > off}), error + off


def _summaries(texts: DataFrame, capacity: int) -> DataFrame:
    def task(batches):
        import pyarrow as pa
        lists = (b.slice(i, 64).column(0).to_pylist() for b in batches for i in range(0, b.num_rows, 64))
        held, error = summary(lists, capacity)
        terms = [w.decode() for w in held]
        yield pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.array([*held.values(), error], pa.int64())], ["term", "c"])

    return texts.mapInArrow(task, "term string, c long")


def frequent_terms(df: DataFrame, col: str, k: int = 20, capacity: int = CAPACITY) -> DataFrame:
    """``(rank, term, count, documents)`` of the ``k`` most frequent terms of ``col`` (ties by term),
    with the number of rows that hold them.  Missing texts are left out."""
    texts = df.select(qcol(col).cast("string").alias("text")).where("text is not null")
    spark = df.sparkSession
    while True:
        found = shared_table(_summaries(texts, capacity), "terms").groupBy("term").agg(F.sum("c").alias("low"))
        found = shared_table(found, "terms")
        error = (found.where("term is null").agg(F.sum("low")).first()[0]) or 0
        lows = found.where("term is not null")
        kth = lows.orderBy(F.desc("low"), "term").limit(k).agg(F.min("low"), F.count(F.lit(1))).first()  # k rows
        least = kth[0] if kth[1] == k else 0
        candidates = lows.where(F.col("low") + error >= F.lit(least))
        if error == 0 or (error < least and candidates.count() <= CANDIDATES):
            break
        capacity *= 4
    if error == 0:  # nothing was taken off anywhere: all counts are exact
        candidates = lows.orderBy(F.desc("low"), "term").limit(k)
    wanted = [r["term"] for r in candidates.select("term").collect()]  # at most CANDIDATES, or k
    bc = spark.sparkContext.broadcast(frozenset(w.encode() for w in wanted))

    def task(batches):
        from collections import Counter

        import pyarrow as pa
        counts, rows, known = Counter(), Counter(), bc.value
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for t in b.slice(i, 64).column(0).to_pylist():
                    own = Counter(w for w in _words(t) if w in known)
                    counts.update(own)
                    rows.update(own.keys())
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64()),
                                          pa.array([rows[w] for w in counts], pa.int64())], ["term", "c", "d"])

    exact = texts.mapInArrow(task, "term string, c long, d long").groupBy("term").agg(F.sum("c").alias("count"), F.sum("d").alias("documents"))
    top = exact.orderBy(F.desc("count"), "term").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("count"), "term")).alias("rank"), "term", "count", "documents")  # k rows


def text_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, texts, empty, shortest, mean_length, longest, words)`` of string columns: lengths
    in characters, ``words`` the mean number of terms."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"] if cols is None else cols
    schema = "column_name string, texts long, empty long, shortest int, mean_length double, longest int, words double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    aggs, cells = [], []
    for i, c in enumerate(cols):
        n = F.length(qcol(c))
        words = F.size(F.filter(F.split(qcol(c), "[ \t\n\x0b\f\r]+"), lambda w: w != ""))
        aggs += [F.count(n).alias(f"n{i}"), F.count_if(n == 0).alias(f"e{i}"), F.min(n).alias(f"lo{i}"), F.avg(n).alias(f"m{i}"), F.max(n).alias(f"hi{i}"),
                 F.avg(F.when(qcol(c).isNotNull(), words)).alias(f"w{i}")]
        cells.append(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("texts"), F.col(f"e{i}").alias("empty"), F.col(f"lo{i}").alias("shortest"),
                              F.col(f"m{i}").alias("mean_length"), F.col(f"hi{i}").alias("longest"), F.col(f"w{i}").alias("words")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))
