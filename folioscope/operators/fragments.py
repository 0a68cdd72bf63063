"""Fragment search over names: a trigram index that says which names can match a pattern, and the pattern itself after it.

Every three neighbouring characters of a lower-cased name are a row (gram, row), sorted by gram; how often each gram is
there is kept beside. A pattern of LIKE (case aside) has literal pieces between its wildcards; a name that matches has all
their grams. Of these the RAREST are looked up, so grams that nearly every name has are not read, and only rows that
have all of them are read and compared. Patterns without a piece of three characters are compared with all names.

Defined results: the rows are those of `name ILIKE pattern` ("%" any characters, "_" one, "\\" takes the next as it is);
null names match nothing; equal names are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.places import written

#: Grams that are looked up for a pattern, and rows that are named in a scan's filter; more are joined.
RAREST, NAMED = 4, 1000


def pieces(pattern: str) -> list[str]:
    """The literal pieces of a pattern between its wildcards."""
    out, now, escaped = [], "", False
    for c in pattern:
        if escaped:
            now, escaped = now + c, False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            out.append(now)
            now = ""
        else:
            now += c
    return [x for x in [*out, now] if x]


class FragmentIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.names = spark.read.parquet(f"{path}/names")

    @staticmethod
    def build(rows: DataFrame, path: str, *, id_col: str, name_col: str) -> FragmentIndex:
        """Write the index of (id, name) rows."""
        spark = rows.sparkSession
        own = rows.select(F.col(id_col).alias("id"), F.col(name_col).cast("string").alias("name")).filter("name IS NOT NULL")
        # rows are numbered as they are written, so that a row's number says where it lies
        written(own, "fragment-rows").withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/names")
        names = spark.read.parquet(f"{path}/names")
        # characters side by side: substrings by place would go over a long name once a place
        each = names.select("row", F.split(F.lower("name"), "").alias("chars"))
        after = lambda n: F.slice("chars", n + 1, F.greatest(F.size("chars") - n, F.lit(0)))
        joined = lambda a, b: F.concat(a, b)
        three = F.zip_with(F.zip_with("chars", after(1), joined), after(2), joined)
        grams = each.select("row", F.explode(F.array_distinct(three)).alias("gram")).filter(F.length("gram") == 3)
        grams.repartitionByRange("gram", "row").sortWithinPartitions("gram", "row").write.parquet(f"{path}/grams")
        spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return FragmentIndex(spark, path)

    def candidates(self, pattern: str) -> DataFrame | None:
        """(row) of names that can match: those with the pattern's rarest grams. None where the pattern has no gram."""
        low = self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
        wanted = sorted({p[i : i + 3] for p in pieces(low) for i in range(len(p) - 2)})
        if not wanted:
            return None
        counts = {r.gram: r.n for r in self.spark.read.parquet(f"{self.path}/counts").filter(F.col("gram").isin(wanted)).collect()}
        rarest = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[:RAREST]
        grams = self.spark.read.parquet(f"{self.path}/grams")
        if not counts.get(rarest[0], 0):
            return grams.select("row").limit(0)
        return grams.filter(F.col("gram").isin(rarest)).groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select("row")

    def search(self, pattern: str) -> DataFrame:
        """(id, name) of the names that match."""
        found, names = self.candidates(pattern), self.names
        if found is not None:
            found = written(found, "fragment-candidates")
            few = [r.row for r in found.limit(NAMED + 1).collect()]
            names = names.filter(F.col("row").isin(few)) if len(few) <= NAMED else names.join(found, "row", "left_semi")
        return names.filter(F.ilike("name", F.lit(pattern))).select("id", "name")
