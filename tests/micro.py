"""A few claims rows for tests."""

from claimsieve.schema import LOGICAL, MEASURES


def claims(spark, submitted, allowed, text="A", **columns):
    """Rows that differ in their charges only, apart from a provider number of their own."""
    rows = []
    for i, (s, a) in enumerate(zip(submitted, allowed)):
        row = {f.name: text for f in LOGICAL.fields if f.dataType.simpleString() == "string"}
        row |= {m: 1.0 for m in MEASURES}
        row |= {"Provider_ID": i, "Procedure_Code": "00100", "Provider_RUCA_Code": None}
        row |= {"Average_Submitted_Charge": s, "Average_Medicare_Allowed": a}
        row |= {name: values[i] for name, values in columns.items()}
        rows.append(tuple(row[name] for name in LOGICAL.fieldNames()))
    return spark.createDataFrame(rows, LOGICAL)
