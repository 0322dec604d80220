"""Mixing sources to target weights by iterative proportional fitting (native: DataFrame functions only).

Token counts are summed to cells (source, language, topic); raking multiplies the cells by
factors until each of the three marginals has its target share of the tokens; each document is then
sampled with its cell's calibrated probability.

How large the sample is: with ``share``, the expected tokens are that share of all tokens. Cells that cannot give what
they are asked for give all they have, and the rest is raked again. Without it the most wanted cell has probability 1,
so the rarest value sets the size: one document of a new source or without a language can shrink the sample to a few percent.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups
from .exact_dedup import MARK

#: Default targets: a value's share of the tokens to this power, rescaled to sum 1 (1 leaves shares as they are, 0 makes them equal).
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Raking ends when no factor of a round differs from 1 by more than TOLERANCE, or after ROUNDS rounds where the targets contradict each other.
ROUNDS = 40
TOLERANCE = 1e-9
#: Where full cells keep the targets out of reach, filling ends when the same cells stay full and no margin moves by more than this.
SETTLED = 1e-3
#: Share of the tokens that the pipeline's sample has.
SHARE = 0.5
#: Cells of a partition of the raked table; and the most cells that are broadcast to the documents (others meet them as groups).
CELLS = 100_000


def words(text: Column) -> Column:
    """Words of a text, as the token weight."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_topic(text: Column) -> Column:
    """A topic stand-in for tables without one: the band of the text's length."""
    n = F.length(text)
    return F.when(n < 1000, "brief").when(n < 4000, "article").otherwise("long")


def tempered_targets(cells: DataFrame, margins: dict[str, float]) -> dict[str, DataFrame]:
    """For each margin a table (value, target) of shares that sum to 1."""
    out = {}
    for name, power in margins.items():
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").withColumn("t", F.pow("t", F.lit(power)))
        total = sums.agg(F.sum("t").alias("_all"))  # one row
        out[name] = sums.crossJoin(F.broadcast(total)).select(name, (F.col("t") / F.col("_all")).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """``cells`` (margins and tokens) with ``weight``, the raked tokens as a share of all; and the largest marginal error of the last round.

    A ``weight`` that the cells have is raked further. Values without a target keep their weight in that margin. Every round rakes each margin in
    turn; the table of cells is written after each round, so the plan stays short. Ends when the error is TOLERANCE at most.
    """
    parts = -(-cells.count() // CELLS) or 1
    names = [c for c in cells.columns if c != "weight"]
    fitted, error = (cells if "weight" in cells.columns else cells.withColumn("weight", F.col("tokens").cast("double"))), 0.0
    for _ in range(rounds):
        fitted = fitted.coalesce(parts).withColumn("_error", F.lit(0.0))
        for name, target in targets.items():
            sums = fitted.groupBy(name).agg(F.sum("weight").alias("_sum"))
            factor = sums.join(target, name).select(
                name, F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(1.0).alias("_factor")
            )
            fitted = fitted.join(factor, name, "left").withColumn("_factor", F.coalesce("_factor", F.lit(1.0)))
            fitted = fitted.withColumns({"weight": F.col("weight") * F.col("_factor"), "_error": F.greatest("_error", F.abs(F.col("_factor") - 1))}).drop("_factor")
        done = cut(fitted)
        error = done.agg(F.max("_error")).first()[0] or 0.0
        fitted = done.select(*names, "weight")
        if error <= TOLERANCE:
            break
    return fitted, error


def fill(fitted: DataFrame, share: float) -> tuple[DataFrame, int]:
    """``fitted`` with ``weight`` as a share of the sample, whose tokens are ``share`` of all, and the number of full cells.

    A cell's weight is at most its tokens; what the full cells lack, the others give in proportion. Newton's
    steps on a concave sum never pass the factor sought and end when no further cell fills; each is one row of sums.
    Where cells of weight 0 hold the tokens that are lacking, the sample is smaller.
    """
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return fitted, 0
    room = F.col("tokens") / F.lit(float(total * share))
    factor, full = 0.0, -1
    while True:
        filled = F.col("weight") * factor >= room
        wanted = F.col("weight") > 0
        row = fitted.where(wanted).agg(
            F.count(F.when(filled, 1)).alias("full"), F.sum(F.when(filled, room)).alias("given"), F.sum(F.when(~filled, F.col("weight"))).alias("free")
        ).first()
        if row.full == full or not row.free:
            break
        full, factor = row.full, max(factor, (1 - (row.given or 0.0)) / row.free)
    whole = (F.col("weight") * factor >= room) if row.free else wanted
    return fitted.withColumn("weight", F.when(whole, room).otherwise(F.col("weight") * factor)), row.full


def rake_to_size(cells: DataFrame, targets: dict[str, DataFrame], share: float, rounds: int = ROUNDS) -> DataFrame:
    """``rake`` to a sample of ``share`` of all tokens: cells are filled at most, and while any is full the rest is raked again, until that moves nothing or ``rounds`` times."""
    fitted, full = fill(rake(cells, targets, rounds)[0], share)
    for _ in range(rounds):
        if not full:
            break
        again, error = rake(fitted, targets, 1)
        fitted, now = fill(again, share)
        if error <= TOLERANCE or (now == full and error <= SETTLED):
            break
        full = now
    return fitted


def uniform(id_col: str, seed: str = "mix") -> Column:
    """A fixed number in [0, 1) for an id, from MD5, so that other engines can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_weights(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    margins: dict[str, float] | None = None,
    targets: dict[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    share: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per input row: id, source, lang, topic, tokens, prob, sampled.

    ``prob`` is the cell's raked tokens over its tokens. With ``share`` the sample's expected tokens are that share
    of all, and have the target marginals as far as the tokens suffice; without it the most wanted cell
    has probability 1, and the sample's size is that of the rarest value. Null margins count as ''.
    Documents without tokens weigh nothing and have probability 0. An empty table gives no rows.
    ``strict`` raises where targets contradict each other, which only warns otherwise (with ``share`` they are met as far as they can be).
    ``targets`` holds a table (value, target) per margin; the default tempers the table's own shares.
    """
    margins = margins or TEMPER
    rows = cut(_cells(docs.select(F.col(id_col).alias("id"), text_col, "source", "lang"), text_col, topic).select("id", *NAMES, "tokens"))
    probs = calibrate(rows, margins, targets, rounds, share, strict)
    out = join_groups(rows, probs, list(margins), "docs")
    prob = F.when(F.col("tokens") > 0, F.col("prob")).otherwise(0.0)
    return out.select(F.col("id").alias(id_col), *NAMES, "tokens", prob.alias("prob"), (uniform("id") < prob).alias("sampled"))


NAMES = ("source", "lang", "topic")


def _cells(docs: DataFrame, text_col: str, topic: Column | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("source", "lang")}
    kind = length_topic(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    return docs.withColumns(blank | {"topic": kind, "tokens": words(text)})


def calibrate(rows: DataFrame, margins: dict[str, float], targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, share: float | None = None, strict: bool = False) -> DataFrame:
    """Margins, docs and prob of each cell of ``rows`` (margins and tokens); ``share`` is in (0, 1]. Where a margin is off by more than SETTLED at the end, ``strict`` raises; else it warns."""
    names = list(margins)
    cells = cut(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    targets = targets or {name: cut(target) for name, target in tempered_targets(cells, margins).items()}
    if share is not None:
        if not 0 < share <= 1:
            raise ValueError(f"share of tokens {share}")
        total = cells.agg(F.sum("tokens").cast("double").alias("total"))  # one row
        fitted = rake_to_size(cells, targets, share, rounds).crossJoin(F.broadcast(total))
        prob = F.least(F.lit(1.0), F.col("weight") * F.lit(share) * F.col("total") / F.col("tokens"))
        return cut(fitted.select(*names, "docs", F.when(F.col("tokens") > 0, prob).otherwise(0.0).alias("prob")))
    fitted, error = rake(cells, targets, rounds)
    if error > SETTLED:
        if strict:
            raise ValueError(f"the targets contradict each other: a margin is still off by the factor {1 + error:.6g} after {rounds} rounds")
        warnings.warn(f"raking ended after {rounds} rounds with a margin off by the factor {1 + error:.6g}", stacklevel=2)
    ratio = fitted.select(*names, "docs", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("ratio"))
    top = ratio.agg(F.max("ratio").alias("top"))  # one row
    return cut(ratio.crossJoin(F.broadcast(top)).select(*names, "docs", F.when(F.col("top") > 0, F.col("ratio") / F.col("top")).otherwise(0.0).alias("prob")))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, margins: dict[str, float] | None = None, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, that mix_weights samples. Cells are broadcast if they are CELLS at most, else joined as groups."""
    margins = margins or TEMPER
    rows = _cells(docs.select(text_col, "source", "lang"), text_col, topic).select(*NAMES, "tokens")
    probs = calibrate(rows, margins, None, rounds, share)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = length_topic(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    own = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": kind}
    some = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) > 0
    marked = docs.select("*", *[own[n].alias(f"{MARK}{n}") for n in margins], some.alias(f"{MARK}some"))
    probs = probs.select(*[F.col(n).alias(f"{MARK}{n}") for n in margins], F.col("docs").alias(f"{MARK}docs"), F.col("prob").alias(f"{MARK}prob"))
    on = [f"{MARK}{n}" for n in margins]
    met = marked.join(F.broadcast(probs), on) if probs.count() <= CELLS else join_groups(marked, probs, on, f"{MARK}docs")
    return met.where(F.col(f"{MARK}some") & (uniform(id_col) < F.col(f"{MARK}prob"))).select(*docs.columns)
