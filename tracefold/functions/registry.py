"""Extension points: named rules and step functions, and SQL names for the Python functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracefold.functions.text import TextRule


class Registry:
    """Names to callables or rules, in order of registration; a name is taken once."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str, entry: object) -> object:
        if name in self.entries:
            raise ValueError(f"{self.kind} {name} is registered already")
        self.entries[name] = entry
        return entry

    def step(self, name: str) -> Callable:
        """Decorator that registers a function."""
        return lambda f: self.register(name, f)

    def __getitem__(self, name: str):
        return self.entries[name]

    def rules(self) -> list[TextRule]:
        """The registered text rules, first match first."""
        return [e for e in self.entries.values() if isinstance(e, TextRule)]


def register_sql(spark: SparkSession) -> list[str]:
    """Make ``nfkc(text)`` and ``alias_key(text)`` callable from SQL; returns their names."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    @F.pandas_udf("string")
    def alias_key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()), na_action="ignore")

    for name, f in (("nfkc", nfkc), ("alias_key", alias_key)):
        spark.udf.register(name, f)
    return ["nfkc", "alias_key"]
