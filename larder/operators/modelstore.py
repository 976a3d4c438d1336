"""Saved isolation forests and stored scores.

A model is a versioned table of its nodes (folds x trees x nodes, whatever the size of
the data), beside one row with its features, parameters and the cut. Its folder is named by
the fingerprint of the training rows and the parameters, so the same content finds it again in
any session, in whatever order its rows come, and other content does not.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.fingerprint import fingerprint
from larder.operators.iforest import fit_forest, score_rows
from larder.operators.stages import written
from larder.sources.versions import VersionedTable

c = F.col


@dataclass
class Forest:
    """A fitted forest: score s of a row, and ``if_score`` = s - cut."""
    nodes: pd.DataFrame
    features: list[str]
    max_samples: int
    cut: float
    key: str

    def score(self, rows: DataFrame, pass_cols: list[str]) -> DataFrame:
        """``pass_cols`` with if_score and if_anomaly of each row."""
        s = score_rows(rows, self.features, self.nodes, pass_cols, self.max_samples)
        return s.withColumn("if_score", c("s") - F.lit(self.cut)).withColumn("if_anomaly", c("if_score") > 0).drop("fold", "s")

    def save(self, spark: SparkSession, root: str) -> None:
        nodes = spark.createDataFrame(self.nodes)
        about = json.dumps({"features": self.features, "max_samples": self.max_samples, "cut": self.cut, "key": self.key})
        VersionedTable(spark, os.path.join(root, self.key)).write(nodes.coalesce(1).withColumn("about", F.lit(about)))

    @staticmethod
    def load(spark: SparkSession, root: str, key: str) -> Forest | None:
        """The saved forest of that key; None if there is none."""
        table = VersionedTable(spark, os.path.join(root, key))
        if not table.versions():
            return None
        nodes = table.read().toPandas()
        about = json.loads(nodes["about"].iloc[0])
        return Forest(nodes.drop(columns="about"), about["features"], about["max_samples"], about["cut"], about["key"])


def forest_key(rows: DataFrame, features: list[str], key_cols: list[str], **params) -> str:
    content = fingerprint(rows.select(*dict.fromkeys([*key_cols, *features])))
    return hashlib.sha256(json.dumps([content, features, key_cols, sorted(params.items())]).encode()).hexdigest()[:40]


def cached_forest(rows: DataFrame, features: list[str], key_cols: list[str], root: str, n_trees: int = 200, contamination: float = 0.02,
                  max_samples: int = 256, seed: int = 42) -> tuple[Forest, bool]:
    """The forest of these rows, and whether it was there already; else it is fitted and saved."""
    key = forest_key(rows, features, key_cols, n_trees=n_trees, contamination=contamination, max_samples=max_samples, seed=seed)
    found = Forest.load(rows.sparkSession, root, key)
    if found is not None:
        return found, True
    nodes = fit_forest(rows, features, key_cols, None, n_trees, max_samples, seed)
    s = written(score_rows(rows, features, nodes, key_cols, max_samples), "training-scores")
    cut = s.agg(F.percentile_approx("s", 1.0 - contamination, 10000)).first()[0]
    forest = Forest(nodes, features, max_samples, cut, key)
    forest.save(rows.sparkSession, root)
    return forest, False


def store_scores(scores: DataFrame, path: str, partition: str) -> DataFrame:
    """Write ``scores`` by ``partition``; only the partitions that ``scores`` has are replaced."""
    (scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))
    return scores.sparkSession.read.schema(scores.schema).parquet(path)
