"""Feature vectors: one-hot categories, assembled with measures and flags, scaled."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.operators.labels import HEAD, index_by_join, indexed_labels, label_counts, label_numbers
from claimsieve.schema import ENCODED_CATEGORICALS, LABEL, MEASURES, MIXED_PREFIX
from claimsieve.staging import Workspace

#: Slots that a vector may have. MLlib keeps a name for each on the driver, some 70 bytes.
MAX_SLOTS = 500_000


def columns_with_prefix(df: DataFrame, prefix: str = MIXED_PREFIX) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def label_as_double(df: DataFrame, name: str = LABEL) -> DataFrame:
    return df.withColumn("label", F.col(name).cast("double"))


@dataclass
class Encoder:
    """A fitted chain: the stored table of labels, their names in order, and the vector stages."""

    model: PipelineModel
    labels: DataFrame
    names: dict[str, list[str]]
    head: int = HEAD

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(index_by_join(df, self.labels, list(self.names), self.head, self.names))

    def save(self, path: str) -> None:
        """Everything that :meth:`load` needs, below ``path``."""
        self.model.write().overwrite().save(f"{path}/model")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        columns = [(json.dumps(list(self.names)),)]
        self.labels.sparkSession.createDataFrame(columns, "columns string").write.mode("overwrite").json(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        labels = spark.read.parquet(f"{path}/labels")
        columns = json.loads(spark.read.schema("columns string").json(f"{path}/columns").head()["columns"])
        return cls(PipelineModel.load(f"{path}/model"), labels, ordered_names(labels, columns))


def ordered_names(labels: DataFrame, columns: Sequence[str], max_slots: int = MAX_SLOTS) -> dict[str, list[str]]:
    """The labels of each column in order of their index; an error if they make too many slots."""
    sizes = label_numbers(labels, columns)
    if sum(sizes.values()) > max_slots:
        wide = ", ".join(f"{c}: {n}" for c, n in sizes.items())
        raise ValueError(f"one-hot vectors of {sum(sizes.values())} labels ({wide}); {max_slots} slots is the most")
    found = sorted((r["column"], r["index"], r["label"]) for r in labels.select("column", "index", "label").collect())
    return {c: [label for column, _, label in found if column == c] for c in columns}


def fit_encoder(
    df: DataFrame,
    workspace: Workspace,
    categorical: Sequence[str] = ENCODED_CATEGORICALS,
    numeric: Sequence[str] = MEASURES,
    flags: Sequence[str] | None = None,
    max_slots: int = MAX_SLOTS,
    head: int = HEAD,
) -> Encoder:
    """Fit label indices, one-hot blocks, the assembled vector and its scaling.

    Two passes over ``df``: one counts the labels, one sums the vectors for the scaling. The
    index just after the seen labels, of null and unseen values, is the category that one-hot
    leaves out, so those give an empty block. Give ``flags=()`` to leave the outlier flags,
    which the label derives from, out of the features. Labels beyond ``max_slots`` raise an error:
    MLlib keeps the name of every slot on the driver. At most ``head`` labels of each column are found in a broadcast dictionary.
    """
    flags = columns_with_prefix(df) if flags is None else flags
    labels = workspace.stage(indexed_labels(label_counts(df, categorical), workspace), "labels")
    names = ordered_names(labels, categorical, max_slots)
    indexed = index_by_join(df, labels, categorical, head, names)
    return Encoder(_chain(categorical, numeric, flags).fit(indexed), labels, names, head)


def _chain(categorical: Sequence[str], numeric: Sequence[str], flags: Sequence[str]) -> Pipeline:
    blocks = [f"{c}_OHE" for c in categorical]
    return Pipeline(
        stages=[
            OneHotEncoder(inputCols=[f"{c}_Index" for c in categorical], outputCols=blocks),
            VectorAssembler(inputCols=[*numeric, *flags, *blocks], outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled_features"),
        ]
    )


def encode(df: DataFrame, encoder: Encoder) -> DataFrame:
    return encoder.transform(label_as_double(df))


def to_xy(df: DataFrame, *keep: str) -> DataFrame:
    """What the classifiers read, and columns to keep beside it."""
    return df.select(*keep, "scaled_features", "label")


def slot_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, from the attributes that the assembler left on the column.

    Scaling drops the names; take them from the assembled column.
    """
    groups: Mapping[str, list] = df.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for attrs in groups.values() for a in attrs)
    return [name for _, name in slots]


def flatten_vector(
    df: DataFrame, column: str, names: Sequence[str], keep: Sequence[str] | None = None, beside: Sequence[str] = ()
) -> DataFrame:
    """Vector slots as double columns, behind the columns ``beside``; ``keep`` picks some by name, which a wide vector needs."""
    wanted = list(names if keep is None else keep)
    place = {name: i for i, name in enumerate(names)}
    return df.withColumn("_slots", vector_to_array(column)).select(
        *beside, *(F.col("_slots")[place[name]].alias(name) for name in wanted)
    )
