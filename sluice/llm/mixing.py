"""Mixing sources to target weights: raking token weights to source, language and topic marginals, then sampling.

Documents are first added up to cells (source, language, topic). Iterative proportional fitting scales the cells until the
tokens of every source, language and topic have their target shares, and every document is drawn in proportion to the weight
of its cell, for a sample of a stated size.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.tables import broadcast_if_small, cut, whole_row

TEMPER = 0.85     # a marginal without given shares aims at observed shares to this power
TOLERANCE = 1e-9
CLOSE = 1e-3      # a factor this near to 1 after the last round counts as met
MAX_ROUNDS = 200
ROUNDS = 5        # between two looks at how far the weights still move
STALLED = 4       # looks in which the furthest factor has not halved: it will not get to 1
LIMIT = 10.0      # bound of a weight's distance from its tempered cell, for given targets that contradict each other
SEED = "mix-1"
RATE = 0.5        # share of the tokens that a sample holds where none is asked for
MARGINS = ["source", "lang", "topic"]
_log = logging.getLogger(__name__)
_NULL = "\u0001null"  # a category of its own

_WORD = r"[^ \t\n\x0B\f\r]+"
_MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.\-]+\.[a-z]{2,}"


def topic_of(text: Column) -> Column:
    """A coarse topic from the whole text: empty, markup, licensed, contact or prose."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return (F.when(text.isNull() | ~text.rlike(_WORD), "empty").when(marks * 20 > F.length(text), "markup")
            .when(text.contains("icensed under") | text.contains("License"), "licensed")
            .when(text.rlike(_MAIL), "contact").otherwise("prose"))


def tokens_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone; null keys share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(_NULL))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None) -> DataFrame:
    """(margin, target): shares that add up to 1.

    Categories named in `given` aim at its values, relative to each other; others at their observed share. Without `given`
    all aim at observed shares to the power TEMPER. Categories without tokens have no target.
    """
    seen = cells.groupBy(margin).agg(F.sum("tokens").alias("own")).where("own > 0")
    total = seen.agg(F.sum("own").alias("all"))
    share = F.col("own") / F.col("all")
    if given:
        named = F.map_from_arrays(F.array(*map(F.lit, given)), F.array(*(F.lit(float(v)) for v in given.values())))
        aim = F.coalesce(named[F.col(margin)], share)
    else:
        aim = F.pow(share, F.lit(TEMPER))
    aimed = seen.crossJoin(F.broadcast(total)).select(margin, aim.alias("aim"))
    return aimed.crossJoin(F.broadcast(aimed.agg(F.sum("aim").alias("aims")))).select(
        margin, (F.col("aim") / F.col("aims")).alias("target"))


def rake(cells: DataFrame, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells (source, lang, topic, tokens) with `weight`, so weighted tokens meet the targets of every marginal.

    Weights start at 1, and a weighted total stays the total of tokens. A round takes one shuffle of the cells for each
    marginal; a window holds the cells of one category, not its documents. ROUNDS rounds are written at a time. Ends when no
    factor of a round is further than TOLERANCE from 1, or when the furthest factor has not halved in STALLED looks: targets
    that contradict each other (a language that occurs in one source only, say) would drive weights to 0 or without bound.
    Then the cells themselves are tempered, which gives marginals that agree, and raked to the given targets alone. Where
    those contradict each other too, a weight stays within LIMIT times its tempered cell's, either way. Either is logged;
    `residuals` shows how far from its target each category is.
    """
    given = given or {}
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    flat = cells.select(*MARGINS, "tokens", F.lit(1.0).alias("start"))
    state, met = _raked(flat, {m: _targets(cells, m, given.get(m)) for m in MARGINS}, total)
    if not met:
        _log.warning("targets of sources, languages and topics contradict each other: cells are tempered instead")
        aim = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(TEMPER)))
        aims = cells.agg(F.sum(aim).alias("aims"))
        tempered = cells.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(aims)).select(
            *MARGINS, "tokens", F.coalesce(aim / F.col("aims") * F.col("all") / F.col("tokens"), F.lit(1.0)).alias("start"))
        state, met = _raked(tempered, {m: _targets(cells, m, given[m]) for m in MARGINS if given.get(m)}, total)
        if not met:
            _log.warning("given targets contradict each other: weights are kept within %s times those of tempered cells", LIMIT)
            near = F.least(F.col("start") * LIMIT, F.greatest(F.col("start") / LIMIT, F.col("weight")))
            state = state.withColumn("weight", near)
    return state.select(*MARGINS, "tokens", "weight")


def _raked(cells: DataFrame, targets: dict[str, DataFrame], total: DataFrame) -> tuple[DataFrame, bool]:
    """Cells (source, lang, topic, tokens, start, weight), raked from `start` to the targets, and whether these are met."""
    state = cells
    for m, target in targets.items():
        state = state.join(broadcast_if_small(cut(target, "targets").withColumnRenamed("target", f"{m}_share")), m, "left")
    aims = [(F.col(f"{m}_share") * F.col("all")).alias(f"{m}_aim") for m in targets]
    state = cut(state.crossJoin(F.broadcast(total)).select(
        *MARGINS, "tokens", "start", *aims, F.col("start").alias("weight"), F.lit(0.0).alias("off")), "raked")
    looks = []
    for _ in range(0, MAX_ROUNDS if targets else 0, ROUNDS):
        for _ in range(ROUNDS):
            state = state.withColumn("off", F.lit(0.0))
            for m in targets:
                now = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(m))
                state = state.withColumn("now", now)
                scale = F.when(F.col("now") > 0, F.coalesce(F.col(f"{m}_aim") / F.col("now"), F.lit(1.0))).otherwise(1.0)
                state = state.withColumns({"weight": F.col("weight") * scale, "off": F.greatest("off", F.abs(scale - 1))}).drop("now")
        state = cut(state, "raked")
        looks.append(state.agg(F.max("off")).first()[0] or 0.0)
        if looks[-1] <= TOLERANCE:
            return state, True
        if len(looks) > STALLED and looks[-1] > looks[-1 - STALLED] / 2:
            break
    return state, not targets or looks[-1] <= CLOSE


def residuals(weights: DataFrame, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, category, target, share, residual) of every category of raked cells: its target share, given or tempered, the
    share of the weighted tokens that it has, and the difference. All are near 0 where raking met its targets."""
    cells = weights.select(*MARGINS, "tokens")
    total = F.broadcast(weights.agg(F.sum(F.col("weight") * F.col("tokens")).alias("all")))
    parts = []
    for m in MARGINS:
        shares = weights.groupBy(m).agg(F.sum(F.col("weight") * F.col("tokens")).alias("own")).crossJoin(total).select(
            m, F.try_divide("own", "all").alias("share"))
        parts.append(shares.join(_targets(cells, m, (given or {}).get(m)), m).select(
            F.lit(m).alias("margin"), F.col(m).alias("category"), "target", "share", (F.col("share") - F.col("target")).alias("residual")))
    return parts[0].union(parts[1]).union(parts[2])


def _weighted(df: DataFrame, key: str, text: str, source: str, lang: str,
              given: dict[str, dict[str, float]] | None, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(row, key, tokens, source, lang, topic) for every row, and the raked cells.

    Without `whole` the rows come without `row`, and are written, so that texts are read once.
    """
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL)).alias
    rows = whole_row(df, F.col(key).alias("key"), tokens_of(F.col(text)).alias("tokens"), label(source)("source"),
                     label(lang)("lang"), topic_of(F.col(text)).alias("topic"))
    if not whole:
        rows = cut(rows.drop("row"), "counted")
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    return rows, cut(rake(cells, given), "weights")


def calibrated(df: DataFrame, key: str, text: str, source: str = "source", lang: str = "lang",
               given: dict[str, dict[str, float]] | None = None, seed: str = SEED, rate: float = RATE) -> DataFrame:
    """(key, tokens, source, lang, topic, weight, probability, sampled, residual) for every row.

    Probabilities are the weights times one number, and at most 1, so that the rows marked `sampled` hold `rate` of the tokens
    in expectation, and none comes twice: cells due more than that are taken whole, the others keep their proportions, and a
    rare cell takes no more than its own tokens from them. `sample` hands on the rows themselves. A row is marked if the uniform
    number of its key is below its probability; rows that share a key share the number, and the result is the same in every
    run. `residual` is how far the share of the row's source, language or topic is from its target after raking, whichever is
    furthest: near 0 where the targets agree, and visible where they contradict each other; null without tokens in any of the
    three. Null sources and languages are categories. Rows without tokens count in no marginal; a cell of such rows alone has
    weight 1, or less through its other categories. An empty table gives no rows. Cells are one row per source, language and
    topic, joined by broadcast while their size allows, else by a join whose hot keys Spark splits.
    """
    rows, weights = _weighted(df, key, text, source, lang, given, whole=False)
    left = cut(residuals(weights, given), "residuals")
    chances = weights.withColumn("probability", _chance(weights, rate))
    for m in MARGINS:
        part = left.where(F.col("margin") == m).select(F.col("category").alias(m), F.abs("residual").alias(f"{m}_off"))
        chances = chances.join(broadcast_if_small(part), m, "left")
    chances = cut(chances.select(*MARGINS, "weight", "probability", F.greatest(*[f"{m}_off" for m in MARGINS]).alias("residual")),
                  "chances")
    return rows.join(broadcast_if_small(chances), MARGINS).select(
        "key", "tokens", *MARGINS, "weight", "probability", (uniform(F.col("key"), seed) < F.col("probability")).alias("sampled"),
        "residual")


def _chance(weights: DataFrame, rate: float) -> Column:
    """The probability of a cell's rows, none drawn twice."""
    return F.lit(1.0) if rate >= 1 else F.least(F.lit(1.0), F.col("weight") * _filling(weights, rate))


def _filling(weights: DataFrame, rate: float) -> float:
    """The number c for which the tokens times min(1, c * weight) add up to `rate` of all tokens.

    Every pass but the last takes more cells whole; one row reaches the driver.
    """
    c = rate
    while True:
        whole = F.col("weight") * c >= 1
        got = weights.agg(F.sum("tokens").alias("all"), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("whole"),
                          F.sum(F.when(whole, 0.0).otherwise(F.col("weight") * F.col("tokens"))).alias("rest")).first()
        more = (rate * got["all"] - got["whole"]) / got["rest"] if got["rest"] else c
        if more <= c * (1 + 1e-12):
            return c
        c = more


def sample(df: DataFrame, key: str, text: str, source: str = "source", lang: str = "lang",
           given: dict[str, dict[str, float]] | None = None, seed: str = SEED, rate: float = 1.0, repeat: bool = True) -> DataFrame:
    """Rows of `df`, with its columns, that hold `rate` of its tokens in expectation, in the target shares.

    A row of weight w is due rate * w times: it comes floor(rate * w) times, and once more if the uniform number of its key
    is below the fraction. So a rare cell with a large weight is repeated, and the others keep their rows. Without `repeat`
    no row comes twice: cells due more than once are taken whole and stay short of their shares, and the others keep their
    proportions to each other, scaled by one number so that the size is `rate` all the same.
    """
    rows, weights = _weighted(df, key, text, source, lang, given)
    due = F.col("weight") * rate if repeat else _chance(weights, rate)
    dues = weights.select(*MARGINS, due.alias("due"))
    times = (F.floor("due") + (uniform(F.col("key"), seed) < F.col("due") - F.floor("due")).cast("long")).cast("int")
    drawn = rows.join(broadcast_if_small(dues), MARGINS).withColumn("times", times).where("times > 0")
    if repeat:
        drawn = drawn.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return drawn.select("row.*")


def document_mix(documents: DataFrame) -> DataFrame:
    """Weight, probability and draw of every document, all marginals tempered, for a sample of half of the tokens."""
    rows = calibrated(documents, "doc_id", "text")
    return rows.select(F.col("key").alias("doc_id"), "tokens", "topic", F.round("weight", 6).alias("weight"),
                       F.round("probability", 6).alias("probability"), "sampled", F.round("residual", 6).alias("residual"))


DOCUMENT_MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens,
    coalesce(source, chr(1) || 'null') AS source, coalesce(lang, chr(1) || 'null') AS lang,
    CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'empty'
         WHEN (length(text) - length(translate(text, '#*$%&|<>', ''))) * 20 > length(text) THEN 'markup'
         WHEN contains(text, 'icensed under') OR contains(text, 'License') THEN 'licensed'
         WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.\-]+\.[a-z]{2,}') THEN 'contact' ELSE 'prose' END AS topic
  FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t FROM d GROUP BY ALL),
ts AS (SELECT source, pow(sum(t), 0.85) AS p FROM cells GROUP BY 1),
tl AS (SELECT lang, pow(sum(t), 0.85) AS p FROM cells GROUP BY 1),
tt AS (SELECT topic, pow(sum(t), 0.85) AS p FROM cells GROUP BY 1),
aims AS (SELECT cells.*, ts.p / (SELECT sum(p) FROM ts) * n.a AS s, tl.p / (SELECT sum(p) FROM tl) * n.a AS l,
                tt.p / (SELECT sum(p) FROM tt) * n.a AS o
         FROM cells JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic), (SELECT sum(t) AS a FROM cells) n),
it AS (SELECT 0 AS k, *, 1.0::DOUBLE AS w FROM aims
  UNION ALL
  SELECT k + 1, source, lang, topic, t, s, l, o, w * coalesce(o / nullif(sum(w * t) OVER (PARTITION BY topic), 0), 1) FROM (
    SELECT k, source, lang, topic, t, s, l, o, w * coalesce(l / nullif(sum(w * t) OVER (PARTITION BY lang), 0), 1) AS w FROM (
      SELECT k, source, lang, topic, t, s, l, o, w * coalesce(s / nullif(sum(w * t) OVER (PARTITION BY source), 0), 1) AS w FROM it))
  WHERE k < 60),
z AS (SELECT source, lang, topic, t, w, s, l, o FROM it WHERE k = 60),
-- Cells from the largest weight down: c fills the rate if the cells before are taken whole; the first c that leaves a cell below 1.
o AS (SELECT w, (0.5 * (SELECT sum(t) FROM z) - coalesce(sum(t) OVER (ORDER BY w DESC, source, lang, topic
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w * t) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
      FROM z WHERE t > 0),
fill AS (SELECT arg_max(c, w) AS c FROM o WHERE c * w < 1),
m AS (SELECT source, lang, topic, w, greatest(
        CASE WHEN s > 0 THEN abs(sum(w * t) OVER (PARTITION BY source) - s) END, CASE WHEN l > 0 THEN abs(sum(w * t) OVER (PARTITION BY lang) - l) END,
        CASE WHEN o > 0 THEN abs(sum(w * t) OVER (PARTITION BY topic) - o) END) / (SELECT sum(t) FROM z) AS residual FROM z),
f AS (SELECT source, lang, topic, w, least(1.0, w * (SELECT c FROM fill)) AS p, residual FROM m)
SELECT doc_id, tokens::BIGINT AS tokens, topic, round(w, 6) AS weight, round(p, 6) AS probability,
       ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, chr(1) || 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < p AS sampled,
       round(residual, 6) AS residual
FROM d JOIN f USING (source, lang, topic)
"""
