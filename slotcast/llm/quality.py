"""Quality from a sparse rule ensemble, compiled into Spark column expressions.

Statistics of a text (ratios of words, lines and characters) feed a small forest
of shallow trees. Every path from a root to a node is a rule, a conjunction of
bounds. A logistic regression with a lasso penalty over the rules leaves weights
on few of them, and these become one expression: the score is the logistic
function of the weights of the rules that hold. All fitting is Spark ML over all
labelled rows; only the trees and the weights, whose size is set by parameters,
reach the driver.

Defined results: a null or empty text has statistics of zero and is scored like
any other, a very long one over its whole length; null ids and repeated rows are scored like any other row;
contradictory labels of an id are left out; with labels of one class only, all
texts get its share (1 or 0), without labels 0.5; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.store import owned, settled_labels, stored

WORD = r"[^\x20\x09-\x0D]+"
TREES, DEPTH = 8, 3
LASSO = 0.002
THRESHOLD = 0.3

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, bound), all of which must hold


def _measures() -> dict[str, Column]:
    """Statistics from the columns text, words and lines of a row."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    n_words, n_chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.char_length(text), F.lit(1))
    found = lambda pattern: F.regexp_count(text, F.lit(pattern))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    return {
        "word_length": F.char_length(F.array_join(words, "")) / n_words,
        "words": F.log1p(F.size(words)),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "symbols": found(r"[#*$%&|<>{}=_~^\\/]") / n_chars,
        "shouts": found(r"[!?]") / n_words,
        "upper": found(r"\p{Lu}") / n_chars,
        "digits": found(r"[0-9]") / n_chars,
        "stops": found(r"[.,;:]") / n_words,
        "line_words": n_words / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
    }


STATISTICS = (
    "word_length", "words", "distinct_words", "symbols", "shouts", "upper", "digits", "stops",
    "line_words", "distinct_lines",
)


def with_statistics(documents: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and the statistics of every row, as one struct ``s``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select(
        F.struct(*keep).alias("kept"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    measures = _measures()
    return split.select("kept", F.struct(*[measures[k].cast("double").alias(k) for k in STATISTICS]).alias("s"))


def _paths(node, rule: Rule = ()) -> list[Rule]:
    """All conjunctions from the root to a node below it."""
    if node.getClass().getSimpleName() != "InternalNode":
        return []
    split = node.split()
    name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
    found = []
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        longer = (*rule, (name, at_most, bound))
        found += [longer, *_paths(child, longer)]
    return found


def _holds(rule: Rule) -> Column:
    tests = [F.col(f"s.{n}") <= b if at_most else F.col(f"s.{n}") > b for n, at_most, b in rule]
    return reduce(and_, tests)


class RuleEnsemble:
    """Weighted rules and an intercept; ``expression`` is the score as a column over ``s``."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def expression(self) -> Column:
        total = reduce(
            lambda sum_, rule: sum_ + F.when(_holds(rule[0]), F.lit(rule[1])).otherwise(0.0),
            self.rules, F.lit(self.intercept),
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(statistics: DataFrame, labels: DataFrame, column: str = "quality", seed: int = 5) -> RuleEnsemble:
    """The ensemble of the labelled rows of ``statistics`` (doc_id, s)."""
    with owned(statistics.sparkSession):
        return _fit(statistics, labels, column, seed)


def _fit(statistics: DataFrame, labels: DataFrame, column: str, seed: int) -> RuleEnsemble:
    known = statistics.join(settled_labels(labels, column), "doc_id")
    rows = stored(known.select(F.col("label").cast("double").alias("label"), "s"))
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = 0.5 if not n else ones / n
        return RuleEnsemble([], {0.0: -745.0, 1.0: 745.0}.get(share, 0.0))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.select("label", "s.*", "s"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, bootstrap=False, featureSubsetStrategy="onethird", seed=seed,
        minInstancesPerNode=3,
    ).fit(vectors.select("label", "features"))
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"))})
    names = [f"r{i}" for i in range(len(rules))]
    held = rows.select("label", *[_holds(r).cast("double").alias(n) for r, n in zip(rules, names)])
    lasso = LogisticRegression(
        regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60
    ).fit(VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "features"))
    weights = [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist()) if w]
    return RuleEnsemble(weights, float(lasso.intercept))


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, s) of every row, worked out once: fitting and scoring read the same
    table, which lives until the ``settled`` or ``owned`` call around it ends."""
    return stored(with_statistics(documents, F.col("doc_id")).select("kept.doc_id", "s"))


def keep_good(documents: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose score reaches the threshold.

    The score stands in a projection with a serial number, which Spark moves no
    filter below: statistics are worked out once per row, not once per rule.
    """
    rows = with_statistics(documents, F.struct("*").alias("row"))
    serial = F.monotonically_increasing_id().alias("serial")
    scored = rows.select("kept", "s", serial).select("kept", "serial", model.expression().alias("score"))
    return scored.filter((F.col("serial") >= 0) & (F.col("score") >= threshold)).select("kept.row.*")
