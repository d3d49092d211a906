"""Boosted trees over folds, scored in entity, group and row views."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DOMAIN, KEY, ModelConfig
from ..functions.features import featurize
from .folds import in_domain, leave_one_out
from .metrics import auroc, binary_metrics, choose_threshold, collapse, multiclass_metrics

#: Rounds beyond the patience in the first fit; rows in a task of a fit, whose many jobs are short where rows are few.
FEW_ROUNDS, ROWS_A_TASK = 10, 50_000


def assembled(df: DataFrame, columns: list[str], cfg: ModelConfig) -> DataFrame:
    """The frame with ``features`` (a vector) and ``y``."""
    out = featurize(df, columns, cfg.features)
    inputs = [*columns, *(["log_length"] if cfg.features == "profile" else [])]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(out).withColumn("y", F.col("is_malware").cast("double"))


def _trees(cfg: ModelConfig, rounds: int) -> GBTClassifier:
    return GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=cfg.depth, stepSize=cfg.step, subsamplingRate=cfg.row_share, featureSubsetStrategy=str(cfg.column_share), seed=cfg.seed)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the least loss before ``patience`` rounds without a lesser one, whether these were seen)."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit(train: DataFrame, val: DataFrame, cfg: ModelConfig):
    """(model, best round): rounds stop where validation loss hasn't fallen for ``patience`` rounds.

    Rounds are fitted in doubling numbers, from patience and a few on, until enough have been seen; trees
    are seeded, so a shorter fit is the beginning of a longer one.
    """
    held = train.persist(), val.persist()
    train, val = (df.coalesce(1 + df.count() // ROWS_A_TASK) for df in held)
    try:
        n = min(cfg.rounds, cfg.patience + FEW_ROUNDS)
        while True:
            model = _trees(cfg, n).fit(train)
            best, done = best_round(model.evaluateEachIteration(val), cfg.patience)
            if done or n == cfg.rounds:
                return (model if best == n else _trees(cfg, best).fit(train)), best
            n = min(cfg.rounds, 2 * n)
    finally:
        for df in held:
            df.unpersist()


def scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def _view(test: DataFrame, threshold: DataFrame, view: str) -> DataFrame:
    held = test.select("y", "score").crossJoin(F.broadcast(threshold))
    m = binary_metrics(held, ["threshold"], F.col("threshold"))
    sides = test.agg(F.count_if(F.col("y") == 0).alias("test_benign"), F.count_if(F.col("y") == 1).alias("test_malware"))
    return m.crossJoin(auroc(test, [])).crossJoin(sides).select(F.lit(view).alias("view"), F.col("n").alias("test_n"), "test_benign", "test_malware", "chance", "accuracy", "macro_f1", "mcc", "mcc_half", "auroc", "threshold")


def score_fold(fold: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Entity and group view of one fold (rows with role); the group view keeps the entities' threshold."""
    part = {r: fold.where(F.col("role") == r) for r in ("train", "val", "test")}
    model, best = fit(part["train"], part["val"], cfg)
    threshold = choose_threshold(scores(model, part["val"]), [])
    test = scores(model, part["test"]).select(KEY, "group", "y", "score")
    out = _view(test, threshold, "binary").unionByName(_view(collapse(test, ["group"], KEY), threshold, "group"))
    return out.withColumn("train_n", F.lit(part["train"].count())).withColumn("best_round", F.lit(best))


def score_rows(rows: DataFrame, side: str, cfg: ModelConfig) -> DataFrame:
    """Window, binary and group view of one split of drawn rows."""
    part = {r: rows.where(F.col(side) == r) for r in ("train", "val", "test")}
    model, best = fit(part["train"], part["val"], cfg)
    val, test = (scores(model, part[r]).select(KEY, "group", "position", "y", "score") for r in ("val", "test"))
    binary_val, binary = (collapse(x, [KEY, "group"], "position") for x in (val, test))
    window_cut, binary_cut = choose_threshold(val, []), choose_threshold(binary_val, [])
    out = _view(test, window_cut, "window").unionByName(_view(binary, binary_cut, "binary")).unionByName(_view(collapse(binary, ["group"], KEY), binary_cut, "group"))
    return out.withColumn("split", F.lit(side)).withColumn("best_round", F.lit(best))


def score_folds(folds: DataFrame, cfg: ModelConfig, label: str | None = None) -> DataFrame:
    """Each fold of a table of folds; a label prefixes the experiment's name."""
    out = None
    for experiment, held in sorted({(r.experiment, r.held_out) for r in folds.select("experiment", "held_out").distinct().collect()}):  # a row per fold
        part = score_fold(folds.where((F.col("experiment") == experiment) & (F.col("held_out") == held)), cfg)
        part = part.select(F.lit(f"{label} {experiment}" if label else experiment).alias("experiment"), F.lit(held).alias("held_out"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def run(live: DataFrame, columns: list[str], cfg: ModelConfig, label: str | None = None) -> DataFrame:
    """All in-domain and leave-one-out folds; a label prefixes the experiment's name."""
    rows = assembled(live, columns, cfg)
    return score_folds(in_domain(rows), cfg, label).unionByName(score_folds(leave_one_out(rows), cfg, label))


def run_prefix(store: DataFrame, assignment_live, columns: list[str], cfg: ModelConfig, calls: int, drop: tuple[str, ...] = (), label: str | None = None) -> DataFrame:
    """All folds on a store of first-N rows, less some columns; what isn't a first-N store, or not a column, raises."""
    left = [c for c in columns if c not in drop]
    if len(left) + len(set(drop)) != len(columns):
        raise ValueError(f"not among the columns: {', '.join(sorted(set(drop).difference(columns)))}")
    longest = store.agg(F.max("windows")).first()[0]
    if longest is not None and longest > calls:
        raise ValueError(f"an entity has {longest} rows where {calls} are the most")
    return run(assignment_live(store), left, cfg, label or f"first-{calls}")


def domain_sanity(live: DataFrame, columns: list[str], cfg: ModelConfig) -> DataFrame:
    """Can the domain be told from the features? One row of multi-class metrics on the test split.

    One model per domain against the others, each with its own best round; the largest probability decides.
    """
    rows = assembled(live, columns, cfg).drop("y")
    train = rows.where("split = 'train'")
    index = StringIndexer(inputCol=DOMAIN, outputCol="domain", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    sides = {s: index.transform(rows.where(F.col("split") == s)) for s in ("train", "val", "test")}
    test = sides["test"].withColumn("id", F.monotonically_increasing_id()).persist()
    chances = None
    for k in range(len(index.labels)):  # a model per domain
        against = lambda df: df.withColumn("y", (F.col("domain") == k).cast("double"))  # noqa: B023, E731
        model, _ = fit(against(sides["train"]), against(sides["val"]), cfg)
        part = scores(model, test).select("id", "domain", "score", F.lit(float(k)).alias("k"))
        chances = part if chances is None else chances.unionByName(part)
    chosen = chances.groupBy("id").agg(F.first("domain").alias("y"), F.max_by("k", F.struct("score", -F.col("k"))).alias("prediction"))
    return multiclass_metrics(chosen, "y", "prediction").select(F.lit("architecture-sanity").alias("experiment"), "*")
