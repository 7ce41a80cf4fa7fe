"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic); cell weights are raked until
their marginals meet the targets of all three; documents are then sampled by
probabilities in proportion to what their cell was raked by. Where a cell needs more than it
has, its probability is 1 and the rest is carried by ``weight``, so that weighted tokens
of the sample meet the targets in expectation. ``sample`` has no weights: it keeps as much as lets
every probability stay within 1, so that the tokens of the rows themselves meet the targets.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stash

MARGINS = ("source", "lang", "topic")
#: Cells that the driver rakes in memory at most; more are raked by joins.
MAX_CELLS = 200_000
UNKNOWN = "unknown"
#: Misses of a share beyond this are reported.
MISS = 1e-6


def word_count(text: str | Column) -> Column:
    """White-space separated words; 0 for null and blank texts."""
    c = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.length(c) - F.length(F.translate(c, " ", "")) + 1).cast("long")


def topic_of(text: str, tokens: Column) -> Column:
    """A coarse topic from the text's own form."""
    t = F.col(text)
    return (
        F.when(t.contains("Licensed under") | t.contains("Copyright"), "licence")
        .when(t.contains(" | "), "table")
        .when(t.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"), "contact")
        .when(tokens < 120, "brief")
        .when(tokens < 1200, "article")
        .otherwise("long")
    )


def tempered(totals: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Shares in proportion to a power of what is there: small groups gain, large ones give."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake(base: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, error: float = 1e-10) -> np.ndarray:
    """Weights with the structure of ``base`` whose sums by each of ``codes`` are ``targets``."""
    w = base.astype(float).copy()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            w *= factor[code]
        if worst < error:
            break
    return w


def _raked_by_joins(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 500, error: float = 1e-10) -> DataFrame:
    """``rake`` where cells are too many for the driver: each round is three sums and joins, then stashed."""
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        off = F.lit(0.0)
        for m in MARGINS:
            now = w.groupBy(m).agg(F.sum("w").alias("now")).join(targets[m], m).select(m, F.try_divide("target", "now").alias("f"))
            w = w.join(now, m).withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).withColumn("off", F.greatest(off, F.coalesce(F.abs(F.col("f") - 1), F.lit(0.0)))).drop("f")
            off = F.col("off")
        w = stash(w)
        if w.agg(F.max("off")).first()[0] < error:
            break
        w = w.drop("off")
    return w.select(*MARGINS, "tokens", "w")


def _scale_of(f: np.ndarray, tokens: np.ndarray, keep: float) -> float:
    """c with sum(min(1, c f) tokens) = keep * sum(tokens), where factors can give as much."""
    c, want = 0.0, keep * tokens.sum()
    while True:
        full = c * f >= 1
        part = (f * tokens)[~full].sum()
        nxt = (want - tokens[full].sum()) / part if part > 0 else c
        if nxt <= c * (1 + 1e-14):
            return c
        c = nxt


def _scale(raked: DataFrame, keep: float) -> float:
    """``_scale_of`` by sums on the executors: the same steps."""
    want, c = keep * raked.agg(F.sum("tokens")).first()[0], 0.0
    while True:
        full = F.col("factor") * F.lit(c) >= 1
        r = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("t"), F.sum(F.when(~full, F.col("factor") * F.col("tokens"))).alias("p")).first()
        nxt = (want - (r["t"] or 0)) / r["p"] if r["p"] else c
        if nxt <= c * (1 + 1e-14):
            return c
        c = nxt


def _report(misses: dict[str, float]) -> None:
    """Warns of margins whose raked shares are off their targets: these can't all be reached together, or not yet."""
    if off := {m: round(x, 6) for m, x in misses.items() if x > MISS}:
        warnings.warn(f"mixing targets are not reached; largest miss of a share by margin: {off}", stacklevel=3)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.8, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", weighted: bool = True) -> DataFrame:
    """``docs`` with topic, n_tokens, probability, weight and selected (columns of these names
    are replaced).

    ``targets`` gives shares by value for any of source, lang and topic; a margin that isn't given
    takes ``tempered`` shares. ``keep`` is the expected share of all tokens in the sample. If not
    ``weighted``, every weight is 1 and the selected tokens alone meet the targets: no cell may need
    more than it has, so at most 1 / (the largest raking factor) of all tokens is kept, however large ``keep`` is. Null
    source or lang counts as "unknown"; values without a target get weight 0; texts
    without words weigh nothing and are selected with their cell's probability. Selection hashes the
    id and the seed, so it doesn't change with partitions; repeated ids go together.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep must be within (0, 1]")
    cols = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "weight", "selected")]
    told = docs.select(*cols).withColumn("n_tokens", word_count(text_col)).withColumn("topic", topic_of(text_col, F.col("n_tokens")))
    key = F.struct(*[F.coalesce(F.col(m).cast("string"), F.lit(UNKNOWN)).alias(m) for m in MARGINS])
    cells = stash(told.select(key.alias("cell"), "n_tokens").select("cell.*", "n_tokens").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    if cells.count() <= MAX_CELLS:
        rows = cells.orderBy(*MARGINS).toPandas()
        base = rows["tokens"].to_numpy(float)
        codes, wanted = [], []
        for m in MARGINS:
            names, code = np.unique(rows[m].to_numpy(str), return_inverse=True)
            have = dict(zip(names.tolist(), np.bincount(code, base, len(names)).tolist()))
            share = (targets or {}).get(m) or tempered(have)
            codes.append(code)
            aim = np.array([share.get(k, 0.0) if have[k] else 0.0 for k in names.tolist()])
            wanted.append(aim / (aim.sum() or 1) * base.sum())
        w = rake(base, codes, wanted)
        _report({m: float(np.abs(np.bincount(k, w, len(a)) - a).max(initial=0)) / (base.sum() or 1) for m, k, a in zip(MARGINS, codes, wanted)})
        rows["factor"] = np.divide(w, base, out=np.zeros_like(w), where=base > 0)
        rows.loc[base == 0, "factor"] = 1.0
        factors = docs.sparkSession.createDataFrame(rows.drop(columns="tokens") if len(rows) else [], "source string, lang string, topic string, factor double")
        f, tokens = rows["factor"].to_numpy(float), base
        top = f[base > 0].max(initial=0.0)
    else:
        aims = {}
        for m in MARGINS:
            have = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"))
            given = (targets or {}).get(m)
            share = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(m)] if given else F.pow("have", F.lit(0.7))
            raw = have.withColumn("raw", F.when(F.col("have") > 0, F.coalesce(share, F.lit(0.0))).otherwise(0.0))
            sums = raw.agg(F.sum("raw").alias("r"), F.sum("have").alias("h")).first()
            aims[m] = raw.select(m, (F.col("raw") / F.lit(sums["r"] or 1.0) * F.lit(sums["h"])).alias("target"))
        raked = stash(_raked_by_joins(cells, aims).select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("factor")))
        whole = raked.agg(F.sum("tokens")).first()[0] or 1
        sums = {m: raked.where("tokens > 0").groupBy(m).agg(F.sum(F.col("factor") * F.col("tokens")).alias("is")).join(aims[m], m) for m in MARGINS}
        _report({m: (x.agg(F.max(F.abs(F.col("is") - F.col("target")))).first()[0] or 0.0) / whole for m, x in sums.items()})
        rows, factors = None, raked
        top = raked.where("tokens > 0").agg(F.max("factor")).first()[0]
    c = 1.0
    if top and top > 0:
        c = _scale(factors, keep) if rows is None else _scale_of(f, tokens, keep)
        c = c if weighted else min(c, 1.0 / top)
    odds = factors.select(F.struct(*MARGINS).alias("_cell"), F.least(F.lit(1.0), F.col("factor") * F.lit(float(c))).alias("probability"), F.greatest(F.lit(1.0), F.col("factor") * F.lit(float(c))).alias("weight"))
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = told.select(F.struct(*told.columns).alias("_row"), key.alias("_cell"), u.alias("_u")).join(sized(odds), "_cell", "left")
    return out.select("_row.*", "probability", "weight", F.coalesce(F.col("_u") < F.col("probability"), F.lit(False)).alias("selected"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that ``mix`` selects without weights, columns as they were, whatever their names: their own tokens have the target shares."""
    needed = dict.fromkeys([id_col, text_col, "source", "lang"])
    src = docs.select(F.struct(*docs.columns).alias("_doc"), *needed)
    return mix(src, id_col=id_col, text_col=text_col, **how, weighted=False).where("selected").select("_doc.*")
