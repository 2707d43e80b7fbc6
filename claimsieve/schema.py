"""Column names, types and roles of the provider-by-procedure claims table."""

from __future__ import annotations

from pyspark.sql import types as T

# Published column name -> logical name, in file order.
RAW_TO_LOGICAL = {
    "Rndrng_NPI": "Provider_ID",
    "Rndrng_Prvdr_Last_Org_Name": "Provider_Last_Name",
    "Rndrng_Prvdr_First_Name": "Provider_First_Name",
    "Rndrng_Prvdr_Crdntls": "Provider_Credentials",
    "Rndrng_Prvdr_Type": "Provider_Type",
    "Rndrng_Prvdr_State_Abrvtn": "Provider_State",
    "Rndrng_Prvdr_RUCA": "Provider_RUCA_Code",
    "Rndrng_Prvdr_RUCA_Desc": "Provider_RUCA_Description",
    "Rndrng_Prvdr_Mdcr_Prtcptg_Ind": "Medicare_Participation",
    "HCPCS_Cd": "Procedure_Code",
    "HCPCS_Desc": "Procedure_Description",
    "Tot_Benes": "Total_Beneficiaries",
    "Tot_Srvcs": "Total_Services",
    "Tot_Bene_Day_Srvcs": "Total_Beneficiary_Days",
    "Avg_Sbmtd_Chrg": "Average_Submitted_Charge",
    "Avg_Mdcr_Alowd_Amt": "Average_Medicare_Allowed",
    "Avg_Mdcr_Pymt_Amt": "Average_Medicare_Payment",
    "Avg_Mdcr_Stdzd_Amt": "Average_Standardized_Payment",
}

# Column roles.
CRITICAL = ["Provider_ID", "Procedure_Code"]
MEASURES = [
    "Total_Beneficiaries",
    "Total_Services",
    "Total_Beneficiary_Days",
    "Average_Submitted_Charge",
    "Average_Medicare_Allowed",
    "Average_Medicare_Payment",
    "Average_Standardized_Payment",
]
FILLED_CATEGORICALS = [
    "Provider_Last_Name",
    "Provider_First_Name",
    "Provider_Credentials",
    "Provider_Type",
    "Provider_State",
    "Provider_RUCA_Description",
]
NORMALISED_TEXT = [
    "Provider_Last_Name",
    "Provider_First_Name",
    "Provider_Credentials",
    "Provider_Type",
]
ENCODED_CATEGORICALS = [
    "Provider_Credentials",
    "Provider_Type",
    "Provider_State",
    "Medicare_Participation",
]
PROFILED_MEASURES = MEASURES[:6]

# Names that later stages look up.
SUBMITTED = "Average_Submitted_Charge"
ALLOWED = "Average_Medicare_Allowed"
RATIO = "Valid_Charge_Ratio"
LABEL = "is_fraud"
UNKNOWN = "Unknown"
Z_PREFIX = "Z_Outlier_Flag_"
IQR_PREFIX = "IQR_Outlier_Flag_"
MIXED_PREFIX = "Mixed_Outlier_Flag_"

# Thresholds.
Z_LIMIT = 3.0
IQR_FACTOR = 1.5
RATIO_LIMIT = 10.0
HIGH_CHARGE = 1000.0
QUANTILE_ERROR = 0.01
TRAIN_TEST = (0.7, 0.3)
TREES = 100
DEPTH = 5

_LOGICAL_TYPES = {
    "Provider_ID": T.LongType(),
    "Provider_RUCA_Code": T.DoubleType(),
    **{name: T.DoubleType() for name in MEASURES},
}

LOGICAL = T.StructType(
    [T.StructField(name, _LOGICAL_TYPES.get(name, T.StringType())) for name in RAW_TO_LOGICAL.values()]
)
RAW = T.StructType(
    [T.StructField(raw, LOGICAL[logical].dataType) for raw, logical in RAW_TO_LOGICAL.items()]
)
METRICS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
    ]
)
