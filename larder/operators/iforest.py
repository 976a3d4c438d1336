"""Isolation forest trained and scored on Spark.

Fit
  Every tree gets a deterministic sample of ``max_samples`` rows: a row is a
  candidate for (fold, tree) when a 64-bit hash of (row key, seed, fold, tree)
  falls under a threshold chosen to give about twice the sample size, then
  each (fold, tree) group keeps its smallest hashes. Candidate generation is a
  JVM-side ``filter(sequence)`` per row; groups are ~2x256 rows, built into
  one tree each by ``applyInPandas`` with numpy. Results do not depend on
  partitioning, and the work is spread over (fold, tree) groups.

Model
  One row per node: at most folds x trees x (2*256-1) rows, independent of the
  data size; it is collected once and shipped to the scoring tasks.

Score
  ``mapInPandas`` walks all trees for an Arrow batch at once (vectorised
  numpy, depth <= 8). s(x) = 2^(-E[h(x)] / c(256)); the contamination cut is
  the (1 - contamination) quantile of s over the training rows
  (``percentile_approx``, rank error 1/10000); reported score = s - cut, and
  anomaly = score > 0 (higher = more anomalous).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

_EULER = 0.5772156649015329
_TWO53 = float(1 << 53)


def avg_path_length(n):
    """c(n): mean path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    out = np.where(big, 2.0 * (np.log(np.where(big, n - 1, 1)) + _EULER) - 2.0 * (n - 1) / np.where(big, n, 1), out)
    return out


def feature_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric (not boolean) columns, minus ids and labels."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def feature_matrix(cols: list[str]):
    """C17: NULL -> 0, as double."""
    return [F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(x) for x in cols]


def _u01(*parts):
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(_TWO53)


def _build_tree(X: np.ndarray, rng: np.random.RandomState, max_depth: int):
    """Nodes as parallel lists: feature, threshold, left, right, size (-1 = leaf)."""
    feat, thr, left, right, size = [], [], [], [], []

    def new_node():
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(0)
        return len(feat) - 1

    root = new_node()
    stack = [(root, np.arange(X.shape[0]), 0)]
    d = X.shape[1]
    while stack:
        node, idx, depth = stack.pop()
        size[node] = len(idx)
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = usable[rng.randint(usable.size)] if d else 0
        t = rng.uniform(lo[f], hi[f])
        go_left = sub[:, f] < t
        ln, rn = new_node(), new_node()
        feat[node], thr[node], left[node], right[node] = int(f), float(t), ln, rn
        stack.append((rn, idx[~go_left], depth + 1))
        stack.append((ln, idx[go_left], depth + 1))
    return feat, thr, left, right, size


NODE_SCHEMA = ("fold int, tree int, node int, feature int, threshold double, "
               "left int, right int, size int")


def fit_forest(rows: DataFrame, features: list[str], key_cols: list[str], folds: DataFrame | None = None,
               n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> pd.DataFrame:
    """Grow ``n_trees`` per fold. ``rows`` must carry ``segment`` when ``folds``
    (fold, n_train) is given: fold f trains on segments <= f. Without folds
    a single fold 0 trains on every row.

    Returns the node table (bounded size) as pandas for broadcasting.
    """
    psi = max_samples
    X = rows.select(*key_cols, *feature_matrix(features),
                    *(["segment"] if folds is not None else []))
    if folds is None:
        n = X.count()
        folds_pdf = pd.DataFrame({"fold": [0], "n_train": [n]})
        X = X.withColumn("segment", F.lit(0))
    else:
        folds_pdf = folds.select("fold", "n_train").toPandas()
    folds_pdf = folds_pdf.sort_values("fold")
    # Candidate probability per fold: about 2 x psi (+ slack) candidates per tree.
    probs = {int(r.fold): min(1.0, (2.0 * psi + 8.0 * math.sqrt(psi)) / max(int(r.n_train), 1))
             for r in folds_pdf.itertuples()}
    rid = F.xxhash64(*[c(k) for k in key_cols])
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    def picks(f, p):
        def keep(t):
            return _u01(rid, F.lit(seed), F.lit(f), t) < F.lit(p)

        def tag(t):
            return F.struct(F.lit(f).alias("fold"), t.alias("tree"))
        return F.when(c("segment") <= F.lit(f), F.transform(F.filter(trees, keep), tag))

    pairs = [picks(f, p) for f, p in probs.items()]
    arr = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<fold:int,tree:int>>")) for p in pairs]))
    cand = (X.select(*features, rid.alias("_rid"), F.explode(arr).alias("_ft"))
             .select(*features, "_rid", c("_ft.fold").alias("fold"), c("_ft.tree").alias("tree")))
    cand = cand.withColumn("_u", _u01(c("_rid"), F.lit(seed), c("fold"), c("tree")))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, tree = int(pdf["fold"].iloc[0]), int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_u", "_rid"], kind="mergesort").head(psi)
        Xs = pdf[features].to_numpy(dtype="float64")
        rng = np.random.RandomState((seed * 1_000_003 + fold * 10_007 + tree) % (2 ** 32))
        feat, thr, left, right, size = _build_tree(Xs, rng, max_depth)
        k = len(feat)
        return pd.DataFrame({"fold": np.full(k, fold, "int32"), "tree": np.full(k, tree, "int32"),
                             "node": np.arange(k, dtype="int32"), "feature": np.asarray(feat, "int32"),
                             "threshold": np.asarray(thr, "float64"), "left": np.asarray(left, "int32"),
                             "right": np.asarray(right, "int32"), "size": np.asarray(size, "int32")})

    nodes = cand.groupBy("fold", "tree").applyInPandas(grow, NODE_SCHEMA)
    return nodes.toPandas()


def _pack(nodes: pd.DataFrame):
    """fold -> dense arrays [tree, node] for vectorised traversal."""
    model = {}
    for fold, g in nodes.groupby("fold"):
        nt = int(g["tree"].max()) + 1
        nn = int(g["node"].max()) + 1
        arrs = {k: np.full((nt, nn), v, dtype=dt) for k, v, dt in
                [("feature", -1, "int32"), ("threshold", 0.0, "float64"), ("left", -1, "int32"),
                 ("right", -1, "int32"), ("size", 0, "int32")]}
        t, n = g["tree"].to_numpy(), g["node"].to_numpy()
        for k in arrs:
            arrs[k][t, n] = g[k].to_numpy()
        model[int(fold)] = arrs
    return model


def _path_lengths(X: np.ndarray, m) -> np.ndarray:
    nt = m["feature"].shape[0]
    total = np.zeros(X.shape[0])
    rows = np.arange(X.shape[0])
    for t in range(nt):
        node = np.zeros(X.shape[0], dtype="int64")
        depth = np.zeros(X.shape[0])
        feat, thr, left, right = m["feature"][t], m["threshold"][t], m["left"][t], m["right"][t]
        while True:
            f = feat[node]
            inner = f >= 0
            if not inner.any():
                break
            x = X[rows, np.where(inner, f, 0)]
            nxt = np.where(x < thr[node], left[node], right[node])
            node = np.where(inner, nxt, node)
            depth += inner
        total += depth + avg_path_length(m["size"][t][node])
    return total / nt


def score_rows(rows: DataFrame, features: list[str], nodes: pd.DataFrame, pass_cols: list[str],
               max_samples: int = 256, fold_of=None) -> DataFrame:
    """Anomaly score s in (0, 1] per row and fold.

    ``fold_of``: optional Column giving, per row, the array of folds whose
    forest should score it (default: fold 0 only).
    """
    model = _pack(nodes)
    # Normaliser of each fold: its trees may have seen fewer rows than max_samples.
    cn = {f: max(float(avg_path_length(np.array([int(m["size"][:, 0].max())]))[0]), 1e-9) for f, m in model.items()}
    fx = [f"_f{i}" for i in range(len(features))]
    base = rows.select(*pass_cols,
                       *[m.alias(a) for m, a in zip(feature_matrix(features), fx)],
                       (fold_of if fold_of is not None else F.array(F.lit(0))).alias("_folds"))
    ex = base.select(*pass_cols, *fx, F.explode("_folds").alias("fold"))
    fields = [f for f in ex.schema.fields if f.name in pass_cols]
    out_schema = T.StructType(fields + [T.StructField("fold", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def score(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            for fold, g in pdf.groupby("fold", sort=False):
                X = g[fx].to_numpy(dtype="float64")
                s = np.power(2.0, -_path_lengths(X, model[int(fold)]) / cn[int(fold)])
                o = g[pass_cols].copy()
                o["fold"] = int(fold)
                o["s"] = s
                out.append(o)
            yield pd.concat(out, ignore_index=True)

    return ex.mapInPandas(score, out_schema)


def isolation_forest(df: DataFrame, features: list[str], key_cols: list[str], pass_cols: list[str],
                     n_trees: int = 200, contamination: float = 0.02, max_samples: int = 256,
                     seed: int = 42) -> DataFrame:
    """Fit on all rows, score all rows: adds ``if_score`` (s - cut) and ``if_anomaly``."""
    nodes = fit_forest(df, features, key_cols, None, n_trees, max_samples, seed)
    cols = list(dict.fromkeys(pass_cols + key_cols))
    # The cut and the result both read the scores: written once, every row walks the trees once.
    s = score_rows(df, features, nodes, cols, max_samples).checkpoint()
    cut = s.agg(F.percentile_approx("s", 1.0 - contamination, 10000).alias("_cut"))
    out = s.crossJoin(F.broadcast(cut)).withColumn("if_score", c("s") - c("_cut"))
    return out.withColumn("if_anomaly", c("if_score") > 0).drop("fold", "s", "_cut")


def cv_report(rows: DataFrame, features: list[str], key_cols: list[str], value: str, ts: str = "timestamp",
              n_splits: int = 5, n_trees: int = 100, contamination: float = 0.02, max_samples: int = 256,
              seed: int = 42, z_threshold: float = 3.0) -> DataFrame:
    """Time-ordered CV of both detectors in a fixed number of jobs.

    Fold f trains on date segments <= f and tests on segment f + 1. All folds'
    forests are grown in one ``applyInPandas`` job; every row is scored once
    per fold it takes part in; the per-fold cut (training quantile) and the
    test statistics are one aggregate each.
    """
    from larder.operators.anomaly import with_segments, zscore_folds

    seg_rows = with_segments(rows, ts, n_splits).where(c("segment").isNotNull())
    zf = zscore_folds(rows, ts, value, n_splits, z_threshold).checkpoint()  # one row a fold, read three times
    folds_pdf = zf.select("fold", "n_train").toPandas()
    if folds_pdf.empty:
        return zf
    n_folds = int(folds_pdf["fold"].max())
    nodes = fit_forest(seg_rows, features, key_cols, zf.select("fold", "n_train"), n_trees, max_samples, seed)
    # Row in segment s is training data for folds s..n and test data for fold s - 1.
    fold_of = F.filter(F.sequence(F.lit(1), F.lit(n_folds)), lambda f: f >= c("segment") - 1)
    s = score_rows(seg_rows, features, nodes, ["segment"], max_samples, fold_of=fold_of).checkpoint()
    cut = (s.where(c("segment") <= c("fold")).groupBy("fold")
            .agg(F.percentile_approx("s", 1.0 - contamination, 10000).alias("_cut")))
    test = s.where(c("segment") == c("fold") + 1).join(F.broadcast(cut), "fold")
    sc = c("s") - c("_cut")
    stats = test.groupBy("fold").agg(
        F.count_if(sc > 0).alias("if_anomalies"),
        F.avg(sc).alias("if_score_mean"),
        F.stddev_pop(sc).alias("if_score_std"))
    return (zf.join(stats, "fold", "left")
              .select("fold", "n_train", "n_test", F.lit(float(contamination)).alias("if_top_fraction"),
                      F.coalesce(c("if_anomalies"), F.lit(0)).alias("if_anomalies"),
                      "if_score_mean", "if_score_std", "z_anomalies"))
