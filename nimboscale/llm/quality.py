"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark column expressions. A small random forest is grown on
labelled rows; every path from a root is a conjunctive rule over statistics.
Lasso logistic regression over the rules' truth values keeps few of them, and
the survivors are compiled to one column expression, so scoring is a projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from nimboscale.llm.text import bind, without, words
from nimboscale.session import gathered, stored

#: At most about this many labelled rows, chosen by a hash of the id, train the ensemble.
MAX_TRAIN = 40_000
MAX_RULES = 240
STATISTICS = (
    "log_words", "mean_word", "distinct_words", "short_words", "longest_word", "closed_words",
    "upper", "symbols", "digits", "distinct_lines", "line_words",
)


def text_statistics(text: Column) -> Column:
    """Struct of STATISTICS, doubles without nulls; null and blank texts count as empty."""
    clean = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(clean), F.lit(1)).cast("double")

    def of(w: Column) -> Column:
        n = F.size(w)
        some = F.greatest(n, F.lit(1)).cast("double")
        lengths = F.transform(w, lambda x: F.char_length(x))
        lines = F.split(clean, "\n", -1)
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            (F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / some).alias("mean_word"),
            (F.size(F.array_distinct(w)) / some).alias("distinct_words"),
            (F.size(F.filter(w, lambda x: F.char_length(x) <= 3)) / some).alias("short_words"),
            F.coalesce(F.array_max(lengths), F.lit(0)).cast("double").alias("longest_word"),
            (F.size(F.filter(w, lambda x: F.endswith(x, F.lit(".")) | F.endswith(x, F.lit(",")))) / some).alias("closed_words"),
            (F.regexp_count(clean, F.lit(r"\p{Lu}")) / chars).alias("upper"),
            (F.regexp_count(clean, F.lit(r"[^\p{L}\p{N}\s.,]")) / chars).alias("symbols"),
            (F.regexp_count(clean, F.lit(r"\p{Nd}")) / chars).alias("digits"),
            (F.size(F.array_distinct(lines)) / F.size(lines)).cast("double").alias("distinct_lines"),
            F.log1p(n / F.size(lines).cast("double")).alias("line_words"),
        )

    return bind(words(clean), of)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: statistic -> (more than, at most)."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        test = F.lit(True)
        for name, over, most in self.bounds:
            test = test & (F.col(name) > over) if over is not None else test
            test = test & (F.col(name) <= most) if most is not None else test
        return test

    def __str__(self) -> str:
        return " and ".join(f"{'' if o is None else f'{o:.6g} < '}{n}{'' if m is None else f' <= {m:.6g}'}" for n, o, m in self.bounds)


def tree_rules(description: str) -> set[Rule]:
    """Rules of all root paths in a tree's or forest's description."""
    found: set[Rule] = set()
    path: list[tuple[int, str, bool, float]] = []
    for line in description.splitlines():
        if re.match(r"\s*Tree \d+", line):
            path = []
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, STATISTICS[int(m[3])], m[4] == "<=", float(m[5])))
        low: dict[str, float] = {}
        high: dict[str, float] = {}
        for _, name, most, value in path:
            if most:
                high[name] = min(value, high.get(name, value))
            else:
                low[name] = max(value, low.get(name, value))
        found.add(Rule(tuple((n, low.get(n), high.get(n)) for n in sorted({*low, *high}))))
    return found


@dataclass(frozen=True)
class RuleEnsemble:
    """Weights of kept rules and an intercept; ``score`` needs the STATISTICS as columns."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def fit_rules(rows: DataFrame, label: str = "label", trees: int = 24, depth: int = 3, lasso: float = 0.002, seed: int = 5) -> RuleEnsemble:
    """Fit on rows with STATISTICS and a 0/1 ``label``. Rows with a null label are left out.

    With one class only, or no rows, the ensemble is a constant: the smoothed
    share of label 1, or 0.5.
    """
    rows = rows.where(F.col(label).isNotNull()).select(*STATISTICS, F.col(label).cast("double").alias("label"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(_logit((ones + 1) / (n + 2)), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).cache()
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=48, subsamplingRate=0.7, featureSubsetStrategy="0.5", minInstancesPerNode=max(2, n // 1000), seed=seed
    ).fit(vectors)
    rules = sorted(tree_rules(forest.toDebugString), key=lambda r: (len(r.bounds), str(r)))
    # A rule that nearly always or never holds tells nothing; the rest by how well it alone parts the classes.
    if not rules:
        vectors.unpersist()
        return RuleEnsemble(_logit((ones + 1) / (n + 2)), ())
    held = [r.column().cast("int") for r in rules]
    sums = rows.agg(*[F.sum(h).alias(f"n{i}") for i, h in enumerate(held)], *[F.sum(h * F.col("label")).alias(f"p{i}") for i, h in enumerate(held)]).first()

    def gain(i: int) -> float:
        inside, hit = sums[f"n{i}"], sums[f"p{i}"]
        return abs(hit / n - inside / n * ones / n)

    useful = [i for i in range(len(rules)) if max(3, 0.002 * n) <= sums[f"n{i}"] <= n - max(3, 0.002 * n)]
    useful = sorted(useful, key=lambda i: -gain(i))[:MAX_RULES]
    rules = [rules[i] for i in useful]
    truth = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")).cache()
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, tol=1e-5, standardization=False).fit(truth)
    truth.unpersist()
    vectors.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray()) if abs(w) > 1e-6)
    return RuleEnsemble(float(lasso_fit.intercept), kept)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    out = without(docs, *STATISTICS).withColumn("_nb_stats", text_statistics(F.col(text_col)))
    return out.select(*[c for c in out.columns if c != "_nb_stats"], "_nb_stats.*")


def held_out(id_col: Column, parts: int, part: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label_col: str, max_train: int) -> RuleEnsemble:
    """The ensemble for rows (_id, _nb_text) of ``docs``, fitted on about ``max_train`` labelled rows at most, chosen by a hash of the id."""
    own = labels.groupBy("_labelled").agg(F.max(label_col).alias("label")).where("label IS NOT NULL")
    both = docs.select("_id").join(own, F.col("_id") == F.col("_labelled"))
    n = both.count()
    if n > max_train:
        own = own.where(F.pmod(F.xxhash64("_labelled"), F.lit(1 << 20)) < int(max_train / n * (1 << 20)))
    # Only texts of the chosen ids are measured.
    chosen = stored(own.join(both.select("_labelled").distinct(), "_labelled", "left_semi"), "quality-chosen")
    train = docs.join(gathered(chosen), F.col("_id") == F.col("_labelled"))
    return fit_rules(stored(with_statistics(train, "_nb_text").select(*STATISTICS, "label"), "quality-train"))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3,
    max_train: int = MAX_TRAIN,
) -> tuple[DataFrame, RuleEnsemble]:
    """((id, held_out, score, predicted) of every row, the fitted ensemble).

    Labels of held-out ids (crc32 of the id as text, mod 5, is 0) are not read.

    Edge cases: null, empty and blank texts score as empty ones. A null id is
    not held out and has no label. Where the labels repeat an id, its largest
    label counts once for each row with that id. Equal texts score alike.
    Without usable labels all scores are one constant.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_nb_text"))
    model = trained(narrow, labels.where(~held_out(F.col(id_col), 5)).select(F.col(id_col).alias("_labelled"), label_col), label_col, max_train)
    scored = with_statistics(narrow, "_nb_text").select(F.col("_id").alias(id_col), held_out(F.col("_id"), 5).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), model


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, judged by their own text; columns unchanged.

    Edge cases as in ``score_quality``; rows are judged one by one, so repeated
    rows and rows with null ids stay or go by their texts. An empty table gives
    an empty table.
    """
    _, model = score_quality(docs, labels, id_col, text_col, label_col, threshold)
    test = with_statistics(docs.select(F.struct(*docs.columns).alias("_nb_row"), F.col(text_col).cast("string").alias("_nb_text")), "_nb_text")
    return test.where(model.score() >= threshold).select("_nb_row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return score_quality(docs, labels)[0]
