"""One-pass statistics for many fit/lookup feature families.

``fit_bank`` computes count and target sums for every key family in a single
pass over the training rows: each row is expanded once per family (fixed
fan-out, like GROUPING SETS), partially aggregated map-side (a hot key costs one
partial row per task), shuffled once and materialised (it is read once per
family).  Every family takes the same path at every size: its rows are a
distributed table joined on the keys.  One small job gives the exact bytes of
each family; that only decides whether its side of the join is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators.prefix import global_positions
from roadlens.session import ensure_checkpoint_dir

MAX_BROADCAST_BYTES = 64 << 20


@dataclass
class Family:
    name: str
    keys: list[str]
    table: DataFrame                     # __k0, __k1, ... (strings), n, one column per sum
    n_bytes: int                         # exact size of the table's values
    totals: dict = field(default_factory=dict)      # n and the sums over all keys of the family


def key_array(keys: list[str]) -> Column:
    return F.array(*[F.col(k).cast("string") for k in keys])


def fit_bank(train: DataFrame, families: dict[str, list[str]], sums: dict[str, Column]) -> dict[str, Family]:
    """``sums``: name -> 0/1 (or numeric) column summed per key (plus the row count ``n``)."""
    fams = [F.struct(F.lit(name).alias("family"), key_array(keys).alias("key")) for name, keys in families.items()]
    base = train.select(*[c.alias(n) for n, c in sums.items()], F.explode(F.array(*fams)).alias("f"))
    base = base.select("f.family", "f.key", *sums)
    ok = F.forall("key", lambda x: x.isNotNull())
    ensure_checkpoint_dir(train.sparkSession)
    stats = (base.filter(ok).groupBy("family", "key")
             .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(s).cast("double")).alias(s) for s in sums])
             .checkpoint(eager=True))
    key_bytes = F.aggregate("key", F.lit(0), lambda a, k: a + F.octet_length(k) + 16)
    totals = {r["family"]: r for r in stats.groupBy("family").agg(
        F.sum(key_bytes + 8 * (len(sums) + 3)).alias("bytes"), F.sum("n").alias("n"),
        *[F.sum(s).alias(s) for s in sums]).collect()}          # one row per family
    out = {}
    for name, keys in families.items():
        t = stats.filter(F.col("family") == name).select(
            *[F.col("key")[i].alias(f"__k{i}") for i in range(len(keys))], "n", *sums)
        r = totals.get(name)
        out[name] = Family(name, keys, t, r["bytes"] if r else 0,
                           {c: (r[c] if r and r[c] is not None else 0) for c in ("n", *sums)})
    return out


def smoothed(alpha: float, prior: float, min_count: int = 0) -> Column:
    """``(n*mean + alpha*prior)/(n + alpha)``; groups with fewer than ``min_count`` rows get the prior."""
    sm = (F.col("n") * (F.col("y") / F.col("n")) + F.lit(alpha * prior)) / (F.col("n") + F.lit(float(alpha)))
    return F.when(F.col("n") < min_count, F.lit(prior)).otherwise(sm) if min_count else sm


def ranked(fam: Family, out: str) -> Family:
    """Adds the 1-based rank of each key by descending ``n`` (ties by key): exact global positions,
    so no task holds all keys."""
    pos = global_positions(fam.table.withColumn("__neg", -F.col("n")),
                           ["__neg", *[f"__k{i}" for i in range(len(fam.keys))]], out="__pos")
    table = pos.withColumn(out, (F.col("__pos") + 1).cast("double")).drop("__neg", "__pos")
    return Family(fam.name, fam.keys, table, fam.n_bytes, fam.totals)


def apply(df: DataFrame, fam: Family, value_cols: dict[str, Column]) -> DataFrame:
    """Left join of ``value_cols`` (name -> Column over n and the sums); NULL where the key is unseen.

    The family's side is broadcast under ``MAX_BROADCAST_BYTES``; past it the join is a
    shuffle join that AQE sizes and splits."""
    nk = len(fam.keys)
    t = fam.table.select(*[f"__k{i}" for i in range(nk)], *[expr.alias(name) for name, expr in value_cols.items()])
    t = F.broadcast(t) if fam.n_bytes <= MAX_BROADCAST_BYTES else t
    cond = None
    for i, k in enumerate(fam.keys):
        c = F.col(k).cast("string") == F.col(f"__k{i}")
        cond = c if cond is None else cond & c
    return df.join(t, cond, "left").drop(*[f"__k{i}" for i in range(nk)])
