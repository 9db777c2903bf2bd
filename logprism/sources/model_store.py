"""Stored models: a node table, a scaler table and a metadata row per version.

Layout below one root folder::

    <root>/<version>/nodes     Parquet, at most trees x (2 x sample - 1) rows
    <root>/<version>/scaler    Parquet, one row per feature
    <root>/<version>/metadata  JSON lines; deploying appends a line, the newest wins
    <root>/_registry           Parquet, one appended row per saved model
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.functions.formats import parse_iso
from logprism.operators.forest import Forest
from logprism.operators.scaling import Scaler

METADATA_SCHEMA = """
model_info struct<version: string, created_at: string, model_type: string, training_source: string,
  export_file: string, training_id: string>,
training_info struct<training_samples: long, feature_names: array<string>, export_file_size: long,
  training_duration: double, model_parameters: map<string, string>>,
evaluation_info struct<basic_metrics: map<string, double>, score_distribution: map<string, double>,
  cross_validation_score: double, feature_importance: map<string, double>>,
deployment_info struct<status: string, deployed_at: string, deployed_by: string,
  performance_metrics: map<string, string>>,
revision long
"""
REGISTRY_SCHEMA = (
    "version string, path string, created_at string, metrics map<string, double>, status string, "
    "passed_thresholds long, total_thresholds long"
)


@dataclass(frozen=True)
class Model:
    """What is needed to score: scaler, forest nodes, cut, and descriptive metadata."""

    version: str
    scaler: Scaler
    nodes: DataFrame
    offset: float
    metadata: dict = field(default_factory=dict)

    def forest(self) -> Forest:
        return Forest.from_nodes(self.nodes, self.scaler.features)


def build_metadata(
    version: str, created_at: str, model_type: str, samples: int, features: tuple[str, ...],
    parameters: Mapping[str, object], metrics: Mapping[str, float | None],
    distribution: Mapping[str, float], checks: tuple[int, int] = (0, 0), export_file: str | None = None,
    training_id: str | None = None, export_size: int | None = None, duration: float | None = None,
    cv_score: float | None = None, importance: Mapping[str, float] | None = None,
) -> dict:
    """The four metadata sections of a model."""
    known = lambda m: {k: float(v) for k, v in m.items() if v is not None}
    return {
        "model_info": (version, created_at, model_type, "export_data", export_file, training_id),
        "training_info": (samples, list(features), export_size, duration,
                          {k: str(v) for k, v in parameters.items()}),
        "evaluation_info": (known(metrics), known(distribution), cv_score,
                            None if importance is None else known(importance)),
        "deployment_info": ("available", None, None, {}),
        "revision": 0,
        "checks": checks,
    }


def save_model(spark: SparkSession, model: Model, root: str) -> str:
    """Write the tables and the metadata of a model, and add it to the registry."""
    path = f"{root}/{model.version}"
    model.nodes.coalesce(1).write.parquet(f"{path}/nodes")
    model.scaler.to_frame(spark).withColumn("score_offset", F.lit(model.offset)).coalesce(1).write.parquet(f"{path}/scaler")
    meta = model.metadata
    row = tuple(meta[k] for k in ("model_info", "training_info", "evaluation_info", "deployment_info", "revision"))
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.json(f"{path}/metadata")
    passed, total = meta.get("checks", (0, 0))
    entry = (model.version, path, meta["model_info"][1], meta["evaluation_info"][0], "available", passed, total)
    spark.createDataFrame([entry], REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/_registry")
    return path


def load_model(spark: SparkSession, root: str, version: str) -> Model:
    """Read a stored model back."""
    path = f"{root}/{version}"
    table = spark.read.parquet(f"{path}/scaler")
    offset = table.select("score_offset").first()[0]
    return Model(version, Scaler.from_frame(table), spark.read.parquet(f"{path}/nodes"), offset)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """Current metadata of every stored model; unreadable files are ignored."""
    schema = f"{METADATA_SCHEMA}, _corrupt string"
    try:
        rows = (
            spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt")
            .json(f"{root}/*/metadata").select("*", F.col("_metadata.file_path").alias("_file"))
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, _file string")
    good = rows.filter(F.col("_corrupt").isNull() & F.col("model_info.version").isNotNull()).drop("_corrupt")
    newest = good.groupBy(F.col("model_info.version").alias("version")).agg(
        F.max_by(F.struct(*good.columns), "revision").alias("_m"))
    m = F.col("_m")
    return newest.select(
        "version", m["model_info"]["model_type"].alias("model_type"),
        parse_iso(m["model_info"]["created_at"]).alias("created_at"),
        m["training_info"]["training_samples"].alias("training_samples"),
        m["deployment_info"]["status"].alias("status"),
        m["model_info"]["training_id"].alias("training_id"),
        F.regexp_replace(m["_file"], "/metadata/[^/]*$", "").alias("path"),
        *[m[c].alias(c) for c in ("model_info", "training_info", "evaluation_info", "deployment_info")],
        m["revision"].alias("revision"),
    )


def deploy_model(spark: SparkSession, root: str, version: str, at: str, by: str | None = None) -> bool:
    """Append a metadata revision with status 'deployed'; False if the version is unknown."""
    current = read_registry(spark, root).filter(F.col("version") == version)
    row = current.select(
        "model_info", "training_info", "evaluation_info", "revision",
        "deployment_info.performance_metrics",
    ).first()
    if row is None:
        return False
    deployment = ("deployed", at, by, row["performance_metrics"])
    record = (row["model_info"], row["training_info"], row["evaluation_info"], deployment, row["revision"] + 1)
    (spark.createDataFrame([record], METADATA_SCHEMA).coalesce(1)
     .write.mode("append").json(f"{root}/{version}/metadata"))
    return True


def read_registry_entries(spark: SparkSession, root: str) -> DataFrame:
    """The appended registry rows: path, time, metrics, status and check totals."""
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/_registry")
