"""The symbol index as filters over a DataFrame of symbols with an order column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import node_id as make_node_id
from ..schema import qualified_name as make_qualified_name


class SymbolIndex:
    """Symbols (ord, node_id, name, qualified_name, type, file, parent, ...); ord is the order they were added in."""

    def __init__(self, symbols: DataFrame):
        if "node_id" not in symbols.columns:
            symbols = symbols.withColumn("node_id", make_node_id(F.col("type"), F.col("file"), F.col("line"), F.col("name")))
        if "qualified_name" not in symbols.columns:
            symbols = symbols.withColumn("qualified_name", make_qualified_name(F.col("parent"), F.col("name")))
        self.symbols = symbols

    def add_all(self, more: DataFrame) -> SymbolIndex:
        last = self.symbols.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
        return SymbolIndex(self.symbols.unionByName(SymbolIndex(more.withColumn("ord", F.col("ord") + last + 1)).symbols, allowMissingColumns=True))

    def remove(self, node_id: str) -> tuple[SymbolIndex, bool]:
        """The index without the symbol, and whether it was there."""
        there = bool(self.symbols.where(F.col("node_id") == node_id).limit(1).count())
        return SymbolIndex(self.symbols.where(F.col("node_id") != node_id)), there

    def get_by_name(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name).orderBy("ord")

    def get_by_qualified_name(self, name: str) -> DataFrame:
        """The last added."""
        return self.symbols.where(F.col("qualified_name") == name).orderBy(F.desc("ord")).limit(1)

    def get_by_file(self, file: str) -> DataFrame:
        return self.symbols.where(F.col("file") == file).orderBy("ord")

    def find(self, name: str, file: str | None = None) -> DataFrame:
        """The first of the name in the file, else the first of the name."""
        elsewhere = F.lit(0) if file is None else (F.col("file") != file).cast("int")
        return self.symbols.where(F.col("name") == name).orderBy(elsewhere, "ord").limit(1)

    def of_type(self, type_: str) -> DataFrame:
        """function, class, import, interface, type or variable."""
        return self.symbols.where(F.col("type") == type_).orderBy("ord")

    def search_by_prefix(self, prefix: str) -> DataFrame:
        return self.symbols.where(F.col("name").startswith(prefix)).orderBy("ord")

    def methods_of(self, cls: str) -> DataFrame:
        return self.symbols.where((F.col("type") == "function") & (F.col("parent") == cls)).orderBy("ord")

    def duplicates(self) -> DataFrame:
        """(name, n, first_id): names that several symbols have."""
        return self.symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by("node_id", "ord").alias("first_id")).where("n > 1")

    def summary(self) -> DataFrame:
        return self.symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file").alias("files"), F.count_distinct("name").alias("names"))
