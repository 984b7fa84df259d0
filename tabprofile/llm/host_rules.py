"""Quality rules with host verdicts (operator 8).

Rules of single documents are counted over whole texts; their failures are aggregated by
host (``source``), each rule of ``RULES`` for itself: the base rule (few words or repeated
windows), symbols, duplicate lines and the length of words.  A host's raw failure rate says
little if it has few documents, so rates are shrunk with an empirical beta prior a rule: its
mean and variance are those of the hosts' rates, less the variance that sampling alone would
give.  A host with a shrunk rate above ``limit`` is rejected, and its verdict is joined
back to its documents.  A single document is rejected by the base rule alone.

Host counts are combined map-side, so a host with a third of all rows sends one row a
task.  Rejected hosts alone are joined back, and the planner chooses how by their size.

Defined results: null or word-less text has no words, so it fails; null source is no host:
its documents get no host verdict; repeated rows count as documents of their own; with no
spread between hosts the prior is the overall rate with the weight of ``most`` documents;
a text of any length is counted whole, in memory that grows with it;
an empty table gives an empty result; other columns are ignored or carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import SPACE, slices, stored

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: what makes a document fail a rule; the base rule also rejects the document itself
RULES = {"base": "n_words < {least} or 100 * n_repeat_words > {most} * n_words".format(least=LEAST_WORDS, most=MOST_REPEATED),
         "symbols": "5 * n_symbols > n_words", "lines": "10 * n_dup_lines > n_words",
         "length": "word_chars < 2 * n_words or word_chars > 15 * n_words"}
LIMIT = 0.5
MOST = 1_000.0


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """The counts of COUNTS for one text."""
    data = text.encode()
    words = data.split()  # bytes split on exactly the contract's white space
    n = len(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*[words[i:] for i in range(WINDOW)]))
        if len(set(windows)) < len(windows):
            seen, twice = set(), set()
            for w in windows:
                (twice if w in seen else seen).add(w)
            upto = 0  # words before it are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return (n, len(text) - sum(text.count(c) for c in SPACE), sum(data.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), repeated)


def counted(docs: DataFrame, carry) -> DataFrame:
    """carry, host and the rule counts of every row, with base_failed."""
    rows = docs.select(carry.alias("carry"), F.col("source").cast("string").alias("host"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["carry"].dataType.simpleString()

    def task(batches):
        import pyarrow as pa
        for batch in batches:
            for b in slices(batch):
                found = [rule_counts(t.as_py()) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *[pa.array([x[i] for x in found], pa.int64()) for i in range(5)]],
                    ["carry", "host", *COUNTS])

    out = rows.mapInArrow(task, f"carry {kind}, host string, {', '.join(f'{c} long' for c in COUNTS)}")
    return out.select("*", *[F.expr(rule).alias(f"{name}_failed") for name, rule in RULES.items()])


def host_rates(rows: DataFrame, most: float = MOST) -> DataFrame:
    """host, documents, failed and rate (shrunk) of the base rule, and failed_<rule> and rate_<rule>
    of the others: from rows with host and the rules' flags.

    The prior is beta(mean * weight, (1 - mean) * weight).  Its moments are sums over hosts,
    collected as one row."""
    hosts = rows.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("documents"), *[F.sum(F.col(f"{r}_failed").cast("long")).alias(f"failed_{r}") for r in RULES])
    n = F.col("documents")
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).cast("double").alias("nn"),
                  *[F.sum(f"failed_{r}").alias(f"f_{r}") for r in RULES],
                  *[F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / n).alias(f"ff_{r}") for r in RULES]).first()
    return hosts.select("*", *[_shrunk(F.col(f"failed_{r}"), n, s.k, s.n, s[f"f_{r}"], s[f"ff_{r}"], s.nn, most).alias(f"rate_{r}") for r in RULES]) \
        .withColumnsRenamed({"failed_base": "failed", "rate_base": "rate"})


def _shrunk(failed, documents, k, n, f, ff, nn, most: float):
    """The rate of a host under the prior that the sums over all hosts give."""
    mean = f / n if n else 0.0
    weight = most
    between = 0.0
    if n and k > 1 and n > k and 0 < mean < 1:
        # analysis of variance of the 0/1 failures: between and within hosts
        within = (f - ff) / (n - k)
        spread = (ff - n * mean * mean) / (k - 1)
        between = max(0.0, (spread - within) / ((n - nn / n) / (k - 1)))
    if between > 0:
        weight = min(most, max(1.0, mean * (1 - mean) / between - 1))
    return (failed + F.lit(mean * weight)) / (documents + F.lit(weight))


def bad_hosts(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """bad_host: hosts that fail a rule too often, as a stored table, so that the planner knows its
    size and moves no texts to join a small one."""
    worst = F.greatest("rate", *[f"rate_{r}" for r in RULES if r != "base"])
    return stored(host_rates(rows).where(worst > limit).select(F.col("host").alias("bad_host")), "bad-hosts")


def verdicts(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``counted`` rows with kept: neither they nor their host failed.  ``rows`` is read
    twice, so it should be a stored table."""
    bad = bad_hosts(rows, limit)
    return rows.join(bad, rows.host == bad.bad_host, "left").withColumn(
        "kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host")


def judged(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    rows = stored(counted(docs, F.struct("doc_id")), "rule-counts")
    return verdicts(rows, limit).select("carry.doc_id", *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``docs`` without rejected rows, all columns as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    narrow = plain.select(F.col(f"c{names.index('text')}").alias("text"), F.col(f"c{names.index('source')}").alias("source"),
                          F.struct(*[f"c{i}" for i in range(len(names))]).alias("all"))
    # stored with their flags, so that texts are counted once
    rows = stored(counted(narrow, F.col("all")).select("carry", "host", *[f"{r}_failed" for r in RULES]), "rule-counts")
    bad, passed = bad_hosts(rows, limit), rows.where("not base_failed")
    return passed.join(bad, passed.host == bad.bad_host, "left_anti").select("carry.*").toDF(*names)


def oracle_sql(limit: float = LIMIT, most: float = MOST) -> str:
    """DuckDB SQL for ``judged`` over the table documents."""
    rules = {"base": f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words", "symbols": "5 * n_symbols > n_words",
             "lines": "10 * n_dup_lines > n_words", "length": "not word_chars between 2 * n_words and 15 * n_words"}
    failures = " union all ".join(f"select source, '{r}' as rule, {c} as failed from b where source is not null" for r, c in rules.items())
    return rf"""
with t as (select doc_id, source, coalesce(text, '') as text,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
pos as (select doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) as i,
    unnest([array_to_string(w[i:i + {WINDOW} - 1], ' ') for i in range(1, len(w) - {WINDOW} + 2)]) as five
    from t where len(w) >= {WINDOW}),
win as (select doc_id, i, count(*) over (partition by doc_id, five) as c from pos),
rep as (select doc_id, count(distinct j) as n_repeat_words
    from (select doc_id, unnest(range(i, i + {WINDOW})) as j from win where c > 1) group by doc_id),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines
    from (select doc_id, unnest(string_split(text, chr(10))) as line from t)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (select t.doc_id, source, len(w)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from t left join rep using (doc_id) left join lines using (doc_id)),
f as (select *, {rules["base"]} as base_failed from b),
h as (select source, rule, count(*)::double as n, sum(failed::int)::double as f from ({failures}) group by source, rule),
s as (select rule, count(*)::double as k, sum(n) as n, sum(f) as f, sum(f * f / n) as ff, sum(n * n) as nn from h group by rule),
v as (select *, f / n as mean, (f - ff) / (n - k) as within, (ff - f * f / n) / (k - 1) as spread from s),
p as (select rule, mean, case when k > 1 and n > k and mean > 0 and mean < 1 and spread > within
    then least({most}, greatest(1.0, mean * (1 - mean) / ((spread - within) / ((n - nn / n) / (k - 1))) - 1)) else {most} end as weight from v),
bad as (select distinct source from h join p using (rule) where (h.f + mean * weight) / (h.n + weight) > {limit})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and (source is null or source not in (select source from bad)) as kept from f"""
