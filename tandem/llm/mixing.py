"""Soft-membership mixing: document rates whose expected domain token totals match targets.

1. ``fit_domains`` learns, from a table of labelled documents, a naive Bayes
   classifier over binned text statistics and over the words that tell domains
   apart.  Everything is counted by aggregation.
2. ``posteriors`` gives every document its probability of each domain.
3. ``fit_rates`` finds nonnegative rates r that minimise ||A r - T||^2 by projected
   gradient, where A[k, d] is the tokens of document d times its probability of
   domain k, and T the targets.  Documents of one cell of a grid over the posteriors
   share a rate, so one distributed aggregation gives all that the walk needs, exactly:
   the tokens of each cell by domain.  The first grid has at most CELLS cells; beyond 8
   domains, where no full grid is that small, it is one cell.  The walk goes on until the
   optimality condition holds.  Where the targets are not met, the cells with a positive
   rate are split into the halves, by every domain, that have documents, and the walk is
   taken again, until they are no wider than FINEST.  A level adds at most CELLS cells:
   where there would be more, those with the most tokens are split.

Main path: DataFrame functions only.

Defined edge cases: null and empty texts have no tokens and cannot help a target,
so their rate stays at the start value 1; null labels and labels of missing
documents are ignored, several labels of a document count each; without labelled
documents every posterior is uniform over the targets' domains; a target of a
domain no document can be in is left unmet, and of targets that no rates can meet the
nearest totals are reached.  Repeated rows each have a rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import common

#: Bins of each statistic, and words whose counts enter the classifier.
BINS, WORDS = 8, 256
#: Labelled rows the classifier is fitted on at most (those whose id hashes lowest).
MAX_LABELLED = 20_000
STATISTICS = ("length", "word_length", "symbols", "capitals", "digits", "bangs", "bars", "line_length")
#: Weight, in labelled rows, of all domains together in each domain's likelihoods.
PULL = 5.0
#: Words of a text are not independent; each counts by this share, so that one word alone does not decide.
TEMPER = 0.3
#: Cells of the grid over the posteriors at most, and the width at which a cell is not split further.
CELLS, FINEST = 5_000, 1e-4
#: Domains up to which a full grid of two parts a side or more has at most CELLS cells.
DENSE = 8
#: Targets count as met within this share of all tokens; the walk ends within this of its optimum.
MET, OPTIMAL = 1e-6, 1e-9


def words_of(text: Column) -> Column:
    """The tokens of a text: runs without white space and . , ; : ! ? , in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D.,;:!?]+"), F.lit(0))


def statistics(text: Column, n_words: Column) -> dict[str, Column]:
    """Dense statistics of a whole text, from counts of runs."""
    raw = F.coalesce(text, F.lit(""))
    chars, words = F.length(raw) + F.lit(1.0), n_words + F.lit(1.0)
    runs = lambda pattern: F.regexp_count(raw, F.lit(pattern)).cast("double")
    return {
        "length": F.log2(chars),
        "word_length": chars / words,
        "symbols": runs("[#*$%&<>]+") / words,
        "capitals": runs("[A-Z]{2,}") / words,
        "digits": runs("[0-9]+") / words,
        "bangs": runs("[!?]+") / words,
        "bars": runs("[|]") / words,
        "line_length": chars / (runs("\n") + F.lit(1.0)),
    }


@dataclass(frozen=True)
class Domains:
    """A fitted classifier: log priors, log likelihoods of bins, and a table of word weights."""

    names: tuple[str, ...]
    priors: tuple[float, ...]
    cuts: dict[str, tuple[float, ...]]
    bins: dict[str, tuple[tuple[float, ...], ...]]  # statistic -> domain -> bin
    words: DataFrame | None  # word hash, one log likelihood ratio per domain; WORDS rows at most


def _bin_of(x: Column, cuts: tuple[float, ...]) -> Column:
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(x < cuts[i], F.lit(i)).otherwise(out)
    return out


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> Domains:
    """Learns from labelled (id_col, domain_col) rows of docs; only domains in names count."""
    marks = labelled.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain")).where(F.col("_domain").isin(names) & F.col("_id").isNotNull())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # only labels of documents that are there count towards the bound
    marks = common.bounded(common.cut(marks.join(texts.select("_id"), "_id", "left_semi")), "_id", MAX_LABELLED)
    rows = texts.join(F.broadcast(marks), "_id")
    rows = rows.withColumn("_all", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    table = common.cut(rows.select("_domain", *[c.alias(k) for k, c in statistics(F.col("text"), F.size("_all")).items()], F.array_distinct("_all").alias("_words")))
    total = {r["_domain"]: r["count"] for r in table.groupBy("_domain").count().collect()}
    n = sum(total.values())
    if not n:
        return Domains(tuple(names), tuple([float(-np.log(len(names)))] * len(names)), {}, {}, None)
    priors = tuple(float(np.log((total.get(k, 0) + 0.5) / (n + 0.5 * len(names)))) for k in names)
    at = [i / BINS for i in range(1, BINS)]
    quantiles = table.agg(*[F.percentile_approx(k, at, 1000).alias(k) for k in STATISTICS]).first()
    cuts = {k: tuple(sorted(set(quantiles[k]))) for k in STATISTICS}
    binned = table.select("_domain", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bin_of(F.col(k), cuts[k]).alias("b")) for k in STATISTICS])).alias("x"))
    seen = {(r["_domain"], r["k"], r["b"]): r["count"] for r in binned.groupBy("_domain", "x.k", "x.b").count().collect()}
    # a domain with few labels is drawn towards all labelled rows
    whole = {(k, b): sum(seen.get((d, k, b), 0) for d in names) / n for k in STATISTICS for b in range(BINS)}
    bins = {
        k: tuple(tuple(float(np.log((seen.get((d, k, b), 0) + PULL * max(whole[k, b], 1e-4)) / (total.get(d, 0) + PULL))) for b in range(len(cuts[k]) + 1)) for d in names)
        for k in STATISTICS
    }
    # words: document frequencies by domain; those with the most information, WORDS at most
    counts = table.select("_domain", F.explode("_words").alias("w")).groupBy("w").agg(*[F.sum((F.col("_domain") == d).cast("int")).alias(f"c{i}") for i, d in enumerate(names)])
    all_of = sum((F.col(f"c{i}") for i in range(1, len(names))), F.col("c0"))
    rate = (all_of + 0.5) / (n + 1.0)
    ratios = [F.log((F.col(f"c{i}") + PULL * rate) / ((total.get(d, 0) + PULL) * rate)) for i, d in enumerate(names)]
    weight = sum((F.col(f"c{i}") * F.greatest(r, F.lit(0.0)) for i, r in enumerate(ratios) if i), F.col("c0") * F.greatest(ratios[0], F.lit(0.0)))
    scored = counts.where(all_of >= 3).select("w", *[F.least(F.greatest(r, F.lit(-3.0)), F.lit(3.0)).alias(f"l{i}") for i, r in enumerate(ratios)], weight.alias("weight"))
    # a word that is only a little more frequent in a domain says more about a text's length than about its domain
    telling = F.greatest(*[F.col(f"l{i}") for i in range(len(names))], F.lit(0.0)) >= float(np.log(4))
    words = common.cut(scored.where((F.col("weight") > 15) & telling).orderBy(F.desc("weight"), "w").limit(WORDS).drop("weight"))
    return Domains(tuple(names), priors, cuts, bins, words)


def posteriors(docs: DataFrame, domains: Domains, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with its tokens and an array of each domain's probability; returns the two columns' names."""
    k = len(domains.names)
    tokens, p, hits, stat, z = common.fresh(docs, "tokens", "p", "hits", "stat", "z")
    table = [(r["w"], [float(r[f"l{i}"]) for i in range(k)]) for r in domains.words.collect()] if domains.words is not None else []  # WORDS rows
    numbers = lambda values, kind: F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), f"array<{kind}>")
    keys = numbers([w for w, _ in table], "bigint")
    hashed = docs.withColumn(hits, F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)))
    stats = statistics(F.col(text_col), F.size(hits))
    places = F.transform(F.array_intersect(hits, keys), lambda x: F.array_position(keys, x).cast("int") - 1)
    seen = hashed.select(*docs.columns, F.size(hits).cast("long").alias(tokens), places.alias(hits), F.struct(*[c.alias(n) for n, c in stats.items()]).alias(stat))
    added = lambda weights: F.aggregate(F.col(hits), F.lit(0.0), lambda acc, x: acc + F.get(weights, x))
    scores = []
    for i in range(k):
        s = F.lit(domains.priors[i])
        for name, cuts in domains.cuts.items():
            s = s + F.get(F.array(*[F.lit(x) for x in domains.bins[name][i]]), _bin_of(F.col(f"{stat}.{name}"), cuts))
        if table:
            s = s + added(numbers([v[i] for _, v in table], "double")) * TEMPER
        scores.append(s)
    raised = seen.select(*docs.columns, tokens, F.array(*scores).alias(z))
    raised = raised.withColumn(z, F.transform(z, lambda x: F.exp(x - F.array_max(z))))
    return raised.select(*docs.columns, tokens, F.transform(z, lambda x: x / F.aggregate(z, F.lit(0.0), lambda a, y: a + y)).alias(p)), tokens, p


@dataclass(frozen=True)
class Rates:
    """A rate for each cell: of the whole grid, or, of cells that were split, of the cells inside."""

    grids: tuple[int, ...]  # cells to a side, twice as many from level to level
    whole: tuple[float, ...]  # rates by cell number of the first level
    split: tuple[tuple[int, ...], ...]  # of each level, the cells that the next level splits
    inside: tuple[dict[int, float], ...]  # rates by cell number of the later levels
    totals: tuple[float, ...]
    targets: tuple[float, ...]

    def column(self, p: str = "p", tokens: str | None = "tokens") -> Column:
        """The rate of a row with posteriors p; without tokens it is 1."""
        k = len(self.targets)
        numbers = lambda values, kind: F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), f"array<{kind}>")
        rate = None
        for level in range(len(self.grids) - 1, -1, -1):
            cell = _cell(F.col(p), k, self.grids[level])
            if level:
                keys = sorted(self.inside[level - 1])
                own = F.get(numbers([self.inside[level - 1][c] for c in keys], "double"), F.array_position(numbers(keys, "bigint"), cell).cast("int") - 1)
            else:
                own = F.get(numbers(self.whole, "double"), cell.cast("int"))
            rate = own if rate is None else F.when(F.array_contains(numbers(self.split[level], "bigint"), cell), rate).otherwise(own)
        return rate if tokens is None else F.when(F.col(tokens) > 0, rate).otherwise(F.lit(1.0))


def _cell(p: Column, k: int, grid: int) -> Column:
    """The number of the cell of `grid` parts a side that p lies in; the last probability follows from the others.

    Beyond DENSE probabilities it is a hash (two cells of one hash would share a rate, no more), and a grid of 1 is one cell.
    """
    if k > DENSE:
        return F.lit(0).cast("long") if grid == 1 else F.xxhash64(*[F.floor(p[i] * grid).cast("int") for i in range(k - 1)])
    return sum((F.floor(p[i] * grid).cast("long") * F.lit((grid + 1) ** i) for i in range(1, k - 1)), F.floor(p[0] * grid).cast("long")) if k > 1 else F.lit(0).cast("long")


def grid_for(k: int, most: int = CELLS) -> int:
    """The most parts a side, a power of two, with which a grid over k probabilities has at most `most` cells."""
    grid = 1
    while k > 1 and (2 * grid + 1) ** (k - 1) <= most:
        grid *= 2
    return grid


def walk(a: np.ndarray, goal: np.ndarray, r: np.ndarray, optimal: float = OPTIMAL) -> np.ndarray:
    """Projected gradient from r on ||r a - goal||^2 over r >= 0; a holds the tokens of each cell by domain.

    The gradient of a cell is scaled by its tokens, so that cells of equal posteriors
    move alike.  A Newton move on the cells that are free to move is tried first; where
    it gains nothing, accelerated gradient moves follow, until no cell's own move would
    lower the residual any more.
    """
    tokens = a.sum(axis=1)
    p = a / tokens[:, None]
    size = max(float(np.abs(goal).sum()), float(tokens.sum()), 1e-300)
    a, goal = a / size, goal / size
    widest = float(np.linalg.eigvalsh(a.T @ p)[-1])
    before, pace = r, 1.0
    stalled, last = 0, np.inf
    while True:
        miss = r @ a - goal
        slope = p @ miss
        off = np.linalg.norm(miss)
        # what is left to gain: cells at zero that would grow, others that would move
        if off <= optimal or np.abs(r - np.maximum(0.0, r - slope)).max() <= optimal:
            return r
        free = (r > 0) | (slope < 0)
        newton = p @ (np.linalg.pinv(a[free].T @ p[free], rcond=1e-10, hermitian=True) @ miss)
        for part in (1.0, 0.25, 0.0625):
            trial = np.maximum(0.0, r - part * np.where(free, newton, 0.0))
            if np.linalg.norm(trial @ a - goal) <= off * (1 - 0.1 * part):
                before, r, pace = trial, trial, 1.0
                break
        else:
            for _ in range(200):
                ahead = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
                point = r + (pace - 1) / ahead * (r - before)
                new = np.maximum(0.0, point - p @ (point @ a - goal) / widest)
                if ((point - new) * tokens) @ (new - r) > 0:  # it swings: begin anew
                    ahead, new = 1.0, np.maximum(0.0, r - p @ (r @ a - goal) / widest)
                before, r, pace = r, new, ahead
            now = float(np.linalg.norm(r @ a - goal))
            stalled = stalled + 1 if last - now <= 1e-3 * OPTIMAL else 0
            last = now
            if stalled > 3:  # no move gains anything that a double could show
                return r


def fit_rates(soft: DataFrame, targets: list[float]) -> Rates:
    """The rates of documents (tokens, p) whose expected domain totals come nearest to the targets, starting from 1."""
    k, goal = len(targets), np.array(targets, float)
    rows = soft.where("tokens > 0").select("tokens", "p")

    def totals(cells: DataFrame) -> dict[int, np.ndarray]:
        sums = cells.groupBy("cell").agg(*[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(k)])
        return {r["cell"]: np.array([r[f"t{i}"] for i in range(k)]) for r in sums.collect()}  # CELLS rows, or the cells inside of those split

    def within(levels: list[tuple[int, ...]]) -> Column:
        there = F.lit(True)
        for lev, cells in enumerate(levels):
            there = there & _cell(F.col("p"), k, grids[lev]).isin(list(cells))
        return there

    def heaviest(chosen: list[int], level: int) -> list[int]:
        """Those of the chosen cells with the most tokens whose halves with documents are CELLS in all at most."""
        cell, half = _cell(F.col("p"), k, grids[level]), _cell(F.col("p"), k, 2 * grids[level])
        some = rows.where(within([*split, tuple(keys[i][1] for i in chosen)]))
        halves = {r["cell"]: r["n"] for r in some.groupBy(cell.alias("cell")).agg(F.approx_count_distinct(half, 0.02).alias("n")).collect()}  # a row for each chosen cell
        order = sorted(chosen, key=lambda i: (-float(a[i].sum()), keys[i]))
        fit = np.cumsum([1.1 * halves[keys[i][1]] for i in order]) <= CELLS
        return sorted(i for i, ok in zip(order, fit.tolist(), strict=True) if ok)

    grids, split, inside = [grid_for(k)], [], []
    found = totals(rows.select("tokens", "p", _cell(F.col("p"), k, grids[0]).alias("cell")))
    whole = [1.0] * ((grids[0] + 1) ** (k - 1) if k <= DENSE else 1)
    if not found:
        return Rates(tuple(grids), tuple(whole), (), (), (0.0,) * k, tuple(goal.tolist()))
    # every cell that is not split: (level, cell) and its tokens by domain
    keys, a = [(0, c) for c in sorted(found)], np.array([found[c] for c in sorted(found)])
    r = walk(a, goal, np.ones(len(a)))
    size = max(float(np.abs(goal).sum()), 1e-300)
    while np.abs(r @ a - goal).max() > MET * size and 1 / grids[-1] > FINEST:
        level = len(grids) - 1
        chosen = [i for i, (lev, _) in enumerate(keys) if lev == level and r[i] > 0]
        if len(chosen) * 2 ** (k - 1) > CELLS:
            chosen = heaviest(chosen, level)
        if not chosen:
            break
        split.append(tuple(keys[i][1] for i in chosen))
        there = within(split)
        grids.append(2 * grids[-1])
        found = totals(rows.where(there).select("tokens", "p", _cell(F.col("p"), k, grids[-1]).alias("cell")))
        rest = [i for i in range(len(keys)) if i not in set(chosen)]
        keys = [keys[i] for i in rest] + [(level + 1, c) for c in sorted(found)]
        a = np.concatenate([a[rest], [found[c] for c in sorted(found)]])
        r = walk(a, goal, np.concatenate([r[rest], np.ones(len(found))]))
        inside.append({})
    for (level, cell), x in zip(keys, r.tolist(), strict=True):
        if level:
            inside[level - 1][cell] = x
        else:
            whole[cell] = x
    return Rates(tuple(grids), tuple(whole), tuple(split), tuple(inside), tuple((r @ a).tolist()), tuple(goal.tolist()))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", budget: float | None = None) -> DataFrame:
    """One row per document: doc_id, tokens, a posterior per domain, and its rate.

    weights are the shares of tokens each domain is to have; budget the tokens in all
    (by default as many as there are).
    """
    names = list(weights)
    domains = fit_domains(docs, labelled, names, id_col, text_col, domain_col)
    soft, tokens, p = posteriors(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), domains)
    soft = common.cut(soft.select("doc_id", F.col(tokens).alias("tokens"), F.col(p).alias("p")))
    total = float(budget if budget is not None else soft.agg(F.sum("tokens")).first()[0] or 0)
    scale = sum(weights.values())
    rates = fit_rates(soft.select("tokens", "p"), [total * weights[k] / scale for k in names])
    return soft.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{k}") for i, k in enumerate(names)], rates.column().alias("rate"))


def resample(docs: DataFrame, labelled: DataFrame, factors: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """docs with each row as often as its rate says; a document's share in a domain is to count `factors` times.

    The targets are the expected domain totals of documents so weighted.  A rate of 1.3
    gives one row, and a second one if the hash of id and text falls into the lowest
    30 % of its range; so a run on the same rows repeats itself.
    """
    names = list(factors)
    k = len(names)
    domains = fit_domains(docs, labelled, names, id_col, text_col, domain_col)
    soft, tokens, p = posteriors(docs, domains, text_col)
    table = common.cut(soft)
    small = table.select(F.col(tokens).alias("tokens"), F.col(p).alias("p"))
    wanted = sum((F.lit(float(factors[names[j]])) * F.col("p")[j] for j in range(1, k)), F.lit(float(factors[names[0]])) * F.col("p")[0])
    goal = small.agg(*[F.sum(F.col("tokens") * F.col("p")[i] * wanted).alias(f"t{i}") for i in range(k)]).first()
    rates = fit_rates(small, [goal[f"t{i}"] or 0.0 for i in range(k)])
    share = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate = rates.column(p, tokens) + F.lit(1e-9)
    copies = (F.floor(rate) + (share < rate - F.floor(rate)).cast("long")).cast("int")
    (n,) = common.fresh(table, "n")
    return table.withColumn(n, copies).where(F.col(n) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)
