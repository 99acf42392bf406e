r"""Quality rules: robust multivariate outliers among transformed text statistics.

Each text gives a few counts. Hard rules on them fail some texts outright. Of the others, statistics
are transformed to be roughly normal, and the minimum covariance determinant is estimated for each
language and source: from a start at medians and median deviations, concentration steps take the half
of the rows that is nearest by Mahalanobis distance and estimate centre and covariance from it again,
until the determinant no longer falls; a last step reweights. A text is rejected if its distance is
beyond the cutoff. Groups with few rows use their language's estimate, and such languages that of all.

Steps for all groups run together, as aggregations by group over a slim table of statistics, so that a
group with a third of all rows is summed up in every task. Quantiles are exact on values rounded to two
digits, which bounds what an aggregation holds and makes runs agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written
from .words import WordHashes, window_hashes

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: The transformed statistics, and the least standard deviation that each is taken to have: below it a
#: difference says nothing about quality, however alike the texts of a group are.
FEATURES = {"word_length": 0.06, "symbols": 0.25, "dup_lines": 0.35, "repeats": 0.5, "upper": 0.25, "marks": 0.3, "line_words": 0.6}
#: Rows that a group must have for an estimate of its own, and concentration steps at most.
LEAST_ROWS, STEPS = 200, 6


def counts(text: str, hashes: WordHashes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.encode().split()
    if not words:
        return (0,) * len(COUNTS)
    letters = len(text) - sum(map(text.count, SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if len(words) > 3:
        _, inverse, n = np.unique(window_hashes(hashes.of(words), 3), return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : i + len(again)] |= again
        repeated = int(covered.sum())
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_UPPER))
    marks = sum(map(text.count, "!?.,;:"))
    return len(words), letters, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, marks


_NO_UPPER = {i: None for i in range(ord("A"), ord("Z") + 1)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [counts(text.as_py() or "", hashes) for text in batch.column("text")]
        columns = np.array(found, np.int64).reshape(-1, len(COUNTS)).T
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *map(pa.array, columns)], ["doc_id", "lang", "source", *COUNTS])


def _features() -> dict[str, Column]:
    n = F.col("n_words") + 10.0  # a few words' worth of the usual, so that short texts aren't extreme by chance
    per_hundred = lambda c, usual: F.log1p((F.col(c) + usual) * 100 / n)
    return {
        "word_length": F.log((F.col("word_chars") + 45.0) / n),
        "symbols": per_hundred("n_symbols", 0.0),
        "dup_lines": F.log1p(F.col("n_dup_lines") * 20 / (F.col("n_lines") + 3)),
        "repeats": per_hundred("n_repeat_words", 0.0),
        "upper": per_hundred("n_upper", 1.0),
        "marks": per_hundred("n_marks", 1.5),
        "line_words": F.log((F.col("n_words") + 10.0) / (F.col("n_lines") + 1.0)),
    }


def chi_square(share: float, dimensions: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    k = 2 / (9 * dimensions)
    return dimensions * (1 - k + NormalDist().inv_cdf(share) * math.sqrt(k)) ** 3


def _estimates(scale_by: str | None):
    """Sums by group -> centre and inverse of the covariance, scaled so that distances have a chi-square median."""
    p = len(FEATURES)
    floor = np.square(list(FEATURES.values()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                centre = np.array(row.sums) / row.n
                upper = np.zeros((p, p))
                upper[np.triu_indices(p)] = np.array(row.products) / row.n
                spread = upper + np.triu(upper, 1).T - np.outer(centre, centre)
                if scale_by:
                    spread *= max(1.0, math.exp(getattr(row, scale_by)) / chi_square(0.5, p))
                spread = spread + np.diag(np.maximum(floor - np.diag(spread), 0) + 1e-9)
                out.append((row.grp, row.n, centre.tolist(), np.linalg.inv(spread)[np.triu_indices(p)].tolist(), float(np.linalg.slogdet(spread)[1])))
            yield pd.DataFrame(out, columns=["grp", "rows", "centre", "inverse", "logdet"])

    return run


KINDS = "grp string, rows long, centre array<double>, inverse array<double>, logdet double"


def _distance() -> Column:
    """log of the squared Mahalanobis distance of the features from centre, rounded to two digits."""
    x = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    terms = [x[i] * x[j] * F.col("inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(zip(*np.triu_indices(len(x))))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.round(F.log(F.greatest(total, F.lit(1e-6))), 2)


def _moments(rows: DataFrame, *more: Column) -> DataFrame:
    names = list(FEATURES)
    products = F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in zip(*np.triu_indices(len(names)))))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.array(*map(F.sum, names)).alias("sums"), products.alias("products"), *more)


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """grp, rows, centre, inverse, logdet of each grp of rows (grp and FEATURES)."""
    p = len(FEATURES)
    middle = rows.groupBy("grp").agg(F.array(*(F.percentile(F.round(f, 2), F.lit(0.5)) for f in FEATURES)).alias("centre"))
    off = rows.join(small(written(middle, "quality-middle")), "grp").groupBy("grp").agg(
        F.count("*").alias("rows"), F.first("centre").alias("centre"), F.array(*(F.percentile(F.round(F.abs(F.col(f) - F.col("centre")[i]), 2), F.lit(0.5)) for i, f in enumerate(FEATURES))).alias("off")
    )
    floors = F.array(*map(F.lit, FEATURES.values()))
    sd = F.zip_with("off", floors, lambda a, b: F.greatest(a * 1.4826, b))
    at = {int(k): i for k, (i, j) in enumerate(zip(*np.triu_indices(p))) if i == j}
    inverse = F.array(*(1 / (sd[int(at[k])] * sd[int(at[k])]) if k in at else F.lit(0.0) for k in range(p * (p + 1) // 2)))
    found = written(off.select("grp", "rows", "centre", inverse.alias("inverse"), F.lit(math.inf).alias("logdet")), "quality-estimates")
    fallen = math.inf
    for _ in range(STEPS):
        near = rows.join(small(found.select("grp", "centre", "inverse")), "grp").withColumn("distance", _distance())
        limit = written(near.groupBy("grp").agg(F.percentile("distance", F.lit(0.5)).alias("limit")), "quality-limits")
        half = near.join(small(limit), "grp").where("distance <= limit")
        found = written(_moments(half, F.first("limit").alias("limit")).mapInPandas(_estimates(None), KINDS), "quality-estimates")
        total = found.agg(F.sum("logdet")).first()[0]
        if total is None or total > fallen - 0.01:
            break
        fallen = total
    near = rows.join(small(found.select("grp", "centre", "inverse")), "grp").withColumn("distance", _distance())
    limit = written(near.groupBy("grp").agg(F.percentile("distance", F.lit(0.5)).alias("limit")), "quality-limits")
    good = near.join(small(limit), "grp").where(F.col("distance") <= F.col("limit") + math.log(chi_square(0.975, p) / chi_square(0.5, p)))
    again = _moments(good, F.percentile("distance", F.lit(0.5)).alias("unscaled")).mapInPandas(_estimates(None), KINDS)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    return written(again.join(sizes, "grp").select("grp", F.col("size").alias("rows"), "centre", "inverse", "logdet"), "quality-estimates")


def judged(docs: DataFrame, beyond: float = 1e-9, least_words: int = 50, most_repeated: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, COUNTS, base_failed, distance and kept of every row of docs.

    base_failed: fewer than least_words words, or more than most_repeated of them in repeated windows of
    three. distance is the squared Mahalanobis distance from the robust centre of the text's language
    and source (null if base_failed); kept is false if base_failed or if a normal vector would be that
    far off with a probability of less than `beyond`. A null text has no words; null languages and
    sources are groups of their own. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stats = rows.mapInArrow(_counted, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed).withColumns(_features()), "quality-stats")
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    of_lang, of_all = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}), F.lit("{}")
    fit = stats.where("not base_failed").select(F.explode(F.array(own, of_lang, of_all)).alias("grp"), *FEATURES)
    found = minimum_covariance(fit)
    found = found.where((F.col("rows") >= LEAST_ROWS) | (F.col("grp") == "{}"))
    # Each (lang, source) with the estimate that it uses: its own, its language's or that of all.
    groups = stats.groupBy("lang", "source").agg(F.count("*").alias("size")).withColumn("own", own)
    levels = groups.select("own", F.posexplode(F.array(own, of_lang, of_all)).alias("level", "grp"))
    used = levels.join(found, "grp").groupBy("own").agg(F.min_by(F.struct("centre", "inverse"), "level").alias("e")).select("own", "e.centre", "e.inverse")
    table = stats.withColumn("own", own).join(small(written(used, "quality-used")), "own", "left")
    distance = F.when(~F.col("base_failed"), F.exp(_distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(1 - beyond, len(FEATURES)), F.lit(True))
    return table.withColumn("distance", distance).select("doc_id", *COUNTS, "base_failed", "distance", kept.alias("kept"))
