"""The claims table, and the stage tables after it, derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.operators.encoding import encode, fit_encoder
from claimsieve.plans.label import label_claims
from claimsieve.plans.prepare import Prepared, complete_claims, prepare_claims
from claimsieve.schema import RAW_TO_LOGICAL
from claimsieve.session import MIB, narrow_scans, planned_bytes
from claimsieve.sources import write_csv
from claimsieve.staging import Workspace, scratch

EXACT = 0.0

#: Bytes of Parquet up to which the suppliers, whose names alone are joined, are broadcast whatever the session's threshold; some five times as much in memory.
SUPPLIER_BYTES = 64 * MIB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as claims, with nulls, zeros, copies and outliers put in by rule.

    Rows of some parts come a second time: unchanged, or with the name in upper case. The tables that grow are joined
    by sorted shuffles at any size, while rows are narrow; the second one leaves the claims dealt out evenly. The suppliers come last, when
    rows are wide, so they are broadcast up to ``SUPPLIER_BYTES``: Spark's own threshold would end at some hundred thousand of them and move all rows once more.
    """
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    few = planned_bytes(supplier) <= SUPPLIER_BYTES
    supplier = supplier.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    supplier = F.broadcast(supplier) if few else supplier
    joined = (
        line.join(table(spark, sf_dir, "orders").hint("merge"), line.l_orderkey == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    copies = F.expr(
        "explode(CASE l_partkey % 50 WHEN 0 THEN array('row', 'copy')"
        " WHEN 25 THEN array('row', 'upper') ELSE array('row') END)"
    )

    def unless(condition: str, value: str):
        return F.expr(f"CASE WHEN {condition} THEN NULL ELSE {value} END")

    scale = "CASE WHEN l_orderkey % 89 = 0 THEN 6 ELSE 1 END"
    name = "CASE WHEN l_linenumber = 1 THEN concat('  ', upper(s_name), ' ') ELSE s_name END"
    return joined.select("*", copies.alias("kind")).select(
        unless("l_orderkey % 211 = 0", "l_suppkey").alias("Provider_ID"),
        F.expr(f"CASE WHEN kind = 'upper' THEN upper({name}) ELSE {name} END").alias("Provider_Last_Name"),
        unless("l_linenumber = 2", "p_name").alias("Provider_First_Name"),
        unless("l_linenumber = 3", "p_brand").alias("Provider_Credentials"),
        F.col("p_type").alias("Provider_Type"),
        unless("l_linenumber = 4", "n_name").alias("Provider_State"),
        F.col("p_size").cast("double").alias("Provider_RUCA_Code"),
        unless("l_linenumber = 5", "o_orderpriority").alias("Provider_RUCA_Description"),
        F.col("l_linestatus").alias("Medicare_Participation"),
        unless("l_partkey % 307 = 0", "cast(l_partkey AS string)").alias("Procedure_Code"),
        F.col("p_name").alias("Procedure_Description"),
        unless("l_linenumber = 6", "cast(l_quantity AS int)").alias("Total_Beneficiaries"),
        F.col("l_quantity").alias("Total_Services"),
        unless("l_linenumber = 7", "l_quantity * l_linenumber").alias("Total_Beneficiary_Days"),
        F.expr(f"l_extendedprice * {scale}").alias("Average_Submitted_Charge"),
        F.expr(
            f"CASE WHEN l_orderkey % 997 = 0 THEN 0.0D ELSE p_retailprice * l_quantity * {scale} END"
        ).alias("Average_Medicare_Allowed"),
        unless("l_quantity = 13", "l_extendedprice * l_tax").alias("Average_Medicare_Payment"),
        F.expr("l_extendedprice * l_discount").alias("Average_Standardized_Payment"),
    )


def raw_names(claims: DataFrame) -> DataFrame:
    return claims.select(*(F.col(logical).alias(raw) for raw, logical in RAW_TO_LOGICAL.items()))


class Stages:
    """The stage tables of one session and one folder of tables, each written on first use.

    Quantiles are exact here, so that another engine finds the same values. The session's scans are narrow from here on,
    for queries that fold copies when their result is read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        narrow_scans(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.workspace = scratch(spark)
        self._tables: dict[str, object] = {}

    def _once(self, name: str, make):
        if name not in self._tables:
            self._tables[name] = make()
        return self._tables[name]

    def _staged(self, name: str, make) -> DataFrame:
        return self._once(name, lambda: self.workspace.stage(make(), name))

    def claims(self) -> DataFrame:
        return self._staged("claims", lambda: claims_view(self.spark, self.sf_dir))

    def complete(self) -> DataFrame:
        return complete_claims(self.claims())

    def raw_csv(self) -> str:
        def make() -> str:
            write_csv(raw_names(self.claims()), self.workspace.location("raw_csv"))
            return self.workspace.location("raw_csv")

        return self._once("raw_csv", make)

    def prepared(self) -> Prepared:
        return self._once("prepared", lambda: prepare_claims(self.claims(), self.workspace, rel_err=EXACT))

    def cleaned(self) -> DataFrame:
        """Lazy, like the label: filters and flags over the staged population, of which a query reads the columns it needs."""
        return self.prepared().cleaned

    def labelled(self) -> DataFrame:
        return label_claims(self.cleaned())

    def stored_labelled(self) -> DataFrame:
        return self._staged("labelled", self.labelled)

    def encoder(self):
        return self._once("encoder", lambda: fit_encoder(self.labelled(), self.workspace))

    def encoded(self) -> DataFrame:
        """All columns the encoder adds. Lazy, so that the vector columns keep their attributes."""
        return encode(self.labelled(), self.encoder())

    def processed(self) -> DataFrame:
        return self._staged("processed", lambda: self.encoded().select("scaled_features", "label"))

    def scratch(self) -> Workspace:
        """A new folder for a query that writes."""
        return scratch(self.spark)


_STAGES: dict[tuple[str, str], Stages] = {}


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _STAGES:
        _STAGES[key] = Stages(spark, str(sf_dir))
    return _STAGES[key]
