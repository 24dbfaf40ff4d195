"""Search in a gazetteer."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def fold(text: str) -> str:
    """Lower case without combining marks; letters of their own, such as a barred l, stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def folded(name: Column | str) -> Column:
    """`fold` of a column; null stays null."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(fold, na_action="ignore")

    return run(name)


def coordinates(term: str) -> tuple[float, float] | None:
    """(lat, lon) of a term that is a pair of plain decimal numbers in range, latitude first, each perhaps with a degree sign,
    with a comma, a semicolon or blanks between."""
    plain = term.replace(",", " ").replace(";", " ")
    if term.count(",") + term.count(";") > 1:
        return None
    parts = [p.removesuffix("°") for p in plain.replace(" °", "°").split()]
    if len(parts) != 2 or not all(_decimal(p) for p in parts):
        return None
    lat, lon = map(float, parts)
    return (lat, lon) if -90 <= lat <= 90 and -180 <= lon <= 180 else None


def _decimal(text: str) -> bool:
    whole, dot, rest = text.removeprefix("-").partition(".")
    return whole.isdecimal() and whole.isascii() and (not dot or rest.isdecimal() and rest.isascii())


def first_met(entries: DataFrame, term: str, most: int, order: str = "id") -> DataFrame:
    """The first most + 1 entries, by their number, whose folded name holds a term: where a search through a long list may
    stop. All entries that match are ranked by search() itself."""
    return entries.where(F.instr(F.col("folded"), fold(term.strip())) > 0).orderBy(order).limit(most + 1)


def search(entries: DataFrame, term: str, prefix: int = 9, infix: int = 4) -> DataFrame:
    """entries: name, rank, size (null: 0), lon, lat, and optionally folded. Returns part (0 coordinates, 1 names that start
    with the term, 2 names that hold it further on), place, name, lon, lat. Names that agree to a tenth of a degree show
    once. Only terms of over two letters are looked for inside names. A report of the first few, by rank, size and length."""
    spark, want = entries.sparkSession, fold(term.strip())
    schema = "part int, place int, name string, lon double, lat double"
    point = coordinates(term)
    found = spark.createDataFrame([(0, 1, f"{point[0]}, {point[1]}", point[1], point[0])] if point else [], schema)
    if not want:
        return found
    key = F.col("folded") if "folded" in entries.columns else folded("name")
    at = F.instr(key, want)
    hits = entries.select("name", "rank", F.coalesce("size", F.lit(0)).alias("size"), "lon", "lat", at.alias("at")).where(F.col("at") == 1 if len(want) <= 2 else F.col("at") > 0)
    hits = hits.withColumn("part", F.when(F.col("at") == 1, 1).otherwise(2))
    order: list[Column] = [F.col("part"), F.col("rank"), F.desc("size"), F.length("name"), F.col("name"), F.col("lon"), F.col("lat")]
    once = hits.groupBy("name", F.round("lon", 1).alias("x"), F.round("lat", 1).alias("y")).agg(F.min(F.struct("part", "rank", (-F.col("size")).alias("less"), "lon", "lat")).alias("b"))
    once = once.select("b.part", "b.rank", (-F.col("b.less")).alias("size"), "name", "b.lon", "b.lat")
    # the few first of either part, before any window puts a part into one task
    few = once.where("part = 1").orderBy(*order).limit(prefix).union(once.where("part = 2").orderBy(*order).limit(infix))
    placed = few.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    return found.union(placed.select("part", "place", "name", "lon", "lat"))


# -- many terms at once ---------------------------------------------------------------------------------------------------
def _trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def postings(entries: DataFrame) -> DataFrame:
    """entries: entry_id, folded. piece, entry_id: a row for each distinct run of three letters of a name, and for each of its
    first letter and first two, marked ^."""
    starts = F.filter(F.array(F.concat(F.lit("^"), F.left("folded", F.lit(1))), F.when(F.length("folded") > 1, F.concat(F.lit("^"), F.left("folded", F.lit(2))))), lambda p: p.isNotNull() & (p != "^"))
    return entries.select("entry_id", F.explode(F.concat(_trigrams(F.col("folded")), starts)).alias("piece"))


def search_many(entries: DataFrame, terms: DataFrame, prefix: int = 9, infix: int = 4, index: DataFrame | None = None) -> DataFrame:
    """entries: entry_id, name, rank, size (null: 0), lon, lat, and optionally folded. terms: term_id, term. For each term what
    search() finds among names: term_id, part, place, name, lon, lat. index: postings(entries), where they are at hand.

    A term of three letters or more is joined by the one of its pieces that the fewest names have; that leaves few names, which are
    then looked through. Shorter ones are joined by their letters as the start of a name. Of the names of a term and part, the
    first few are kept before they are shuffled."""
    named = entries if "folded" in entries.columns else entries.withColumn("folded", folded("name"))
    index = postings(named) if index is None else index
    asked = terms.select("term_id", folded(F.trim("term")).alias("want")).where("want <> ''")
    pieces = asked.select("term_id", "want", F.explode(F.when(F.length("want") < 3, F.array(F.concat(F.lit("^"), "want"))).otherwise(_trigrams(F.col("want")))).alias("piece"))
    often = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.hint("merge").join(often, "piece", "left").groupBy("term_id", "want").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    # names have dozens of pieces, and a piece thousands of names, which the planner does not count: these are no tables to broadcast
    met = rarest.join(index.hint("merge"), "piece").hint("merge").join(named.select("entry_id", "name", "rank", F.coalesce("size", F.lit(0)).alias("size"), "lon", "lat", "folded"), "entry_id")
    at = F.instr(F.col("folded"), F.col("want"))
    hits = met.where((at == 1) | (at > 1) & (F.length("want") > 2)).withColumn("part", F.when(at == 1, 1).otherwise(2))
    once = hits.groupBy("term_id", "name", F.round("lon", 1).alias("x"), F.round("lat", 1).alias("y")).agg(F.min(F.struct("part", "rank", (-F.col("size")).alias("less"), "lon", "lat")).alias("b"))
    once = once.select("term_id", "name", "b.part", "b.rank", "b.less", "b.lon", "b.lat")
    place = F.row_number().over(W.partitionBy("term_id", "part").orderBy("rank", "less", F.length("name"), "name", "lon", "lat"))
    return once.withColumn("place", place).where(F.col("place") <= F.when(F.col("part") == 1, prefix).otherwise(infix)).where(F.col("place") <= max(prefix, infix)).select("term_id", "part", "place", "name", "lon", "lat")
