"""Schemas of the input tables (fixed values: they describe the files)."""

from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("ROW_ID", T.LongType()),
        T.StructField("JOB_TITLE", T.StringType()),
        T.StructField("SOC_CODE", T.StringType()),
        T.StructField("SOC_TITLE", T.StringType()),
        T.StructField("WORKSITE_CITY", T.StringType()),
        T.StructField("WORKSITE_STATE", T.StringType()),
        T.StructField("NAICS_CODE", T.StringType()),
        T.StructField("FULL_TIME_POSITION", T.StringType()),
        T.StructField("PW_WAGE_LEVEL", T.StringType()),
        T.StructField("CASE_STATUS", T.StringType()),
        T.StructField("PW_UNIT_OF_PAY", T.StringType()),
        T.StructField("WAGE_UNIT_OF_PAY", T.StringType()),
        T.StructField("TOTAL_WORKER_POSITIONS", T.LongType()),
        T.StructField("PREVAILING_WAGE", T.StringType()),
        T.StructField("EMPLOYER_NAME", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("ROW_ID", T.LongType()),
        T.StructField("JOB_TITLE", T.StringType()),
        T.StructField("SOC_CODE", T.StringType()),
        T.StructField("SOC_TITLE", T.StringType()),
        T.StructField("WORKSITE_STATE", T.StringType()),
        T.StructField("NAICS_CODE", T.StringType()),
        T.StructField("FULL_TIME_POSITION", T.StringType()),
        T.StructField("TOTAL_WORKER_POSITIONS", T.LongType()),
        T.StructField("PREVAILING_WAGE", T.DoubleType()),
        T.StructField("estimated_salary_in_usd", T.DoubleType()),
        T.StructField("salary_parse_status", T.StringType()),
        T.StructField("salary_raw_output", T.StringType()),
        T.StructField("IS_AI", T.StringType()),
    ]
)

LABELS = T.StructType([T.StructField("job_title", T.StringType()), T.StructField("AI_job", T.StringType())])

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
