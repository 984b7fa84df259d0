"""Merkle manifest of a dataset by slot pivot (operator 12).

A leaf is the SHA-256 of a row's fields, each written as ``-`` (null) or its UTF-8 byte
count, ``:`` and its value.  Leaves are numbered inside their group in key order by exact
global positions (no task holds a group).  A level of the tree is one conditional
aggregate: ``slot = position % FANOUT`` spreads the children of each parent into columns
s0 to s7, and the columns put together are hashed to the parent.  The same columns without
a child's own are that child's siblings.  The groups' subroots, in order, are the leaves
of a second tree of the same kind, whose root stands for the whole table.

Every level is stored, an eighth of the one below.  Proofs go the other way: a level's
parents, with the path from there to the root, are exploded into their children, so a
path is joined once for eight leaves.  A step of a path holds what stands left and right
of the own slot; folding a leaf over the steps gives the root again, and a leaf that
was made from a changed row gives another.

Defined results: null and empty values differ (``-`` and ``0:``); a group's null name is a
group of its own, before all others; null keys come first; rows with equal keys are ordered by
their leaf hash; repeated rows are leaves of their own; a lone leaf is its subroot, a lone subroot
the root; an empty table gives an empty result and a null root; texts are hashed whole;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import stored
from tabprofile.operators.ranks import positions

FANOUT = 8


def field(c: Column) -> Column:
    """A value with its length, so that no two rows are written alike."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def pivoted(nodes: DataFrame) -> DataFrame:
    """Parents of ``nodes`` (g, at, kid with a field h): g, at, s0 to s7 (kids), h.

    ``at`` 0 without a second kid is a group's only node: it has no parent, and s0 is its
    root (``lone``)."""
    slot = F.col("at") % FANOUT
    kids = [f"s{k}" for k in range(FANOUT)]
    parents = nodes.groupBy("g", F.floor(F.col("at") / FANOUT).alias("at")).agg(
        *[F.max(F.when(slot == k, F.col("kid"))).alias(s) for k, s in enumerate(kids)])
    return parents.select("*", F.sha2(F.concat_ws("", *[F.col(f"{s}.h") for s in kids]), 256).alias("h"))


LONE = "at = 0 and s1 is null"


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The stored levels over ``nodes``, up to the one where every group is lone."""
    found = []
    while True:
        found.append(stored(pivoted(nodes), name))
        above = found[-1].where(f"not ({LONE})")
        if above.isEmpty():
            return found
        nodes = above.select("g", "at", F.struct("h").alias("kid"))


def roots(tree: list[DataFrame]) -> DataFrame:
    """g, root and height (levels above the leaves) of every group."""
    found = None
    for height, level in enumerate(tree):
        own = level.where(LONE).select("g", F.col("s0.h").alias("root"), F.lit(height).alias("height"))
        found = own if found is None else found.unionByName(own)
    return found


def paths(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """g, at, kid and path of the lowest nodes of ``tree``.

    ``above`` has g, height and path, the steps from each group's root on.  A step holds the
    hashes left and right of the own slot."""
    kids = [F.col(f"s{k}") for k in range(FANOUT)]

    def joined(columns):
        return F.concat_ws("", *[c["h"] for c in columns])

    steps = F.array(*[F.when(kids[k].isNotNull(), F.struct(
        kids[k].alias("kid"), F.lit(k).alias("slot"),
        F.struct(joined(kids[:k]).alias("left"), joined(kids[k + 1:]).alias("right")).alias("step"))) for k in range(FANOUT)])
    upper = None
    for height in range(len(tree) - 1, -1, -1):
        parent = above.where(F.col("height") == height).select(F.col("g").alias("own"), F.lit(0).cast("long").alias("place"), "path")
        if upper is not None:
            parent = parent.unionByName(upper.select(F.col("g").alias("own"), F.col("at").alias("place"), "path"))
        rows = tree[height].join(parent, (F.col("g") == F.col("own")) & (F.col("at") == F.col("place")))
        rows = rows.select("g", "at", F.expr(LONE).alias("lone"), "path", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
        path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array("s.step"), F.col("path")))
        upper = rows.select("g", (F.col("at") * FANOUT + F.col("s.slot")).alias("at"), "s.kid", path.alias("path"))
    return upper


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree of their subroots."""
    groups: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def leaves(docs: DataFrame, fields: list[str], key: str, group: str, received: dict[str, Column] | None = None) -> DataFrame:
    """Stored leaves: g (group's name, ordered with null first), key, h and, where
    ``received`` has other values for some fields, seen: the leaf of the row as received."""
    own = leaf(*[F.col(c) for c in fields])
    seen = leaf(*[received.get(c, F.col(c)) for c in fields]) if received else F.lit(None).cast("string")
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    return stored(docs.select(g.alias("g"), F.col(key).alias("key"), own.alias("h"), seen.alias("seen")), "leaves")


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of ``leaves``."""
    kid = F.struct("h", "key", "seen")
    placed = positions(rows, [F.col("key"), F.col("h")], ["g"], "at")
    tree = levels(placed.select("g", "at", kid.alias("kid")), "merkle")
    subroots = stored(positions(roots(tree), [F.col("g")], [], "at"), "subroots")
    top = levels(subroots.select(F.lit("").alias("g"), "at", F.struct(F.col("root").alias("h")).alias("kid")), "merkle-top")
    found = roots(top).first()  # one row
    return Manifest(tree, top, subroots, found and found["root"])


def proofs(m: Manifest) -> DataFrame:
    """key, leaf, subroot, root, path (steps of left and right hashes from the leaf to the
    root), folded (root recomputed from the row as received) and verified."""
    step = "array<struct<left: string, right: string>>"
    start = roots(m.top).select("g", "height", F.array().cast(step).alias("path"))
    top = paths(m.top, start).select(F.col("at").alias("place"), "path")
    above = stored(m.subroots.join(top, F.col("at") == F.col("place")).select("g", "root", "height", "path"), "top-paths")
    found = paths(m.groups, above)
    subroot = above.select(F.col("g").alias("own"), F.col("root").alias("subroot"))
    whole = found.join(subroot, F.col("g") == F.col("own"))
    folded = F.aggregate("path", F.coalesce("kid.seen", "kid.h"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = whole.select(F.col("kid.key").alias("key"), F.col("kid.h").alias("leaf"), "subroot", F.lit(m.root).alias("root"),
                       "path", folded.alias("folded"))
    return out.select("*", (F.col("folded") == F.col("root")).alias("verified"))


def digests(found: DataFrame) -> DataFrame:
    """``proofs`` with the path reduced to the SHA-256 of its hashes."""
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
                        F.col("folded").alias("folded_root"), "verified")


def oracle_sql() -> str:
    """DuckDB SQL for the query: the trees by recursion over levels, CRC-32 bit by bit."""
    fields = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    bits = ("flatten([[(unicode(c) >> b) & 1 for b in [0, 1, 2, 3, 4, 5, 6, 7]] for c in string_split(coalesce(doc_id::varchar, ''), '')])")
    crc = (f"xor(4294967295, list_reduce({bits}, lambda crc, b: "
           "xor(crc >> 1, 3988292384 * xor(crc & 1, b)), 4294967295))")

    def text(c):
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive d as (select doc_id, lang, {fields} || {text('text')} as whole, {fields} || {text(lower)} as lowered,
    case when doc_id is null then 0 else {crc} end % 3 = 0 as changed from documents),
l as (select doc_id, coalesce('=' || lang, '-') as g, sha256(whole) as leaf, sha256(case when changed then lowered else whole end) as seen from d),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from l),
t as (select g, 0 as level, pos, leaf as h, n from p
    union all select g, level + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (max(n) + 7) // 8 from t where n > 1 group by g, level, pos // 8),
s as (select g, h as subroot, level as top_level, row_number() over (order by g) - 1 as place, count(*) over () as groups from t where n = 1),
u as (select 0 as level, place as pos, subroot as h, groups as n from s
    union all select level + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (max(n) + 7) // 8 from u where n > 1 group by level, pos // 8),
a as (select p.g, p.pos as leaf_at, k.level, string_agg(t.h, '' order by t.pos) filter (t.pos < p.pos >> (3 * k.level)) as lft,
        string_agg(t.h, '' order by t.pos) filter (t.pos > p.pos >> (3 * k.level)) as rgt
    from p join s on s.g = p.g join (select unnest(range(0, 30)) as level) k on k.level < s.top_level
    join t on t.g = p.g and t.level = k.level and t.pos // 8 = p.pos >> (3 * k.level + 3)
    group by p.g, p.pos, k.level),
b as (select s.g, k.level, string_agg(u.h, '' order by u.pos) filter (u.pos < s.place >> (3 * k.level)) as lft,
        string_agg(u.h, '' order by u.pos) filter (u.pos > s.place >> (3 * k.level)) as rgt
    from s join (select unnest(range(0, 30)) as level) k on k.level < (select max(level) from u)
    join u on u.level = k.level and u.pos // 8 = s.place >> (3 * k.level + 3)
    group by s.g, k.level),
c as (select g, leaf_at, level, coalesce(lft, '') as lft, coalesce(rgt, '') as rgt from a
    union all select p.g, p.pos, s.top_level + b.level, coalesce(b.lft, ''), coalesce(b.rgt, '') from p join s on s.g = p.g join b on b.g = p.g),
f as (select g, pos, 0 as step, seen as h from p
    union all select f.g, f.pos, step + 1, sha256(c.lft || f.h || c.rgt) from f join c on c.g = f.g and c.leaf_at = f.pos and c.level = f.step),
q as (select g, leaf_at, sha256(string_agg(lft || rgt, '' order by level)) as proof from c group by g, leaf_at)
select p.doc_id, p.leaf, s.subroot, r.h as root, coalesce(q.proof, sha256('')) as proof_sha256, e.h as folded_root, e.h = r.h as verified
from p join s on s.g = p.g join (select h from u where n = 1) r on true
left join q on q.g = p.g and q.leaf_at = p.pos
join (select g, pos, max_by(h, step) as h from f group by g, pos) e on e.g = p.g and e.pos = p.pos"""
