"""Readers of well-known sample tables from files that the caller has."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.frame import Frame

#: Column types of the tables, in the order of their files.
SCHEMAS = {
    "iris": "sepal_length double, sepal_width double, petal_length double, petal_width double, species string",
    "swiss": "province string, Fertility double, Agriculture double, Examination int, Education int, Catholic double, `Infant.Mortality` double",
    "titanic": "PASSENGERID int, SURVIVED int, PCLASS int, NAME string, SEX string, AGE double, SIBSP int, PARCH int, TICKET string, FARE double, CABIN string, EMBARKED string",
}


def read_sample(spark: SparkSession, which: str, path: str, sep: str = ",", header: bool = True) -> Frame:
    """iris, swiss or titanic from a delimited file."""
    if which not in SCHEMAS:
        raise ValueError(f"unknown sample: {which}")
    return Frame(spark.read.csv(path, schema=SCHEMAS[which], header=header, sep=sep))
