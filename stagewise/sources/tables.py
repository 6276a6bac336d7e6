"""Reading interaction logs and metadata; a registry of datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from stagewise import schema as S


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's splits are and what else it has."""

    name: str
    path: str
    has_val: bool = False
    has_loo: bool = False
    domain: str = ""


class Registry:
    """Datasets by name or alias; an unknown name raises."""

    def __init__(self) -> None:
        self._datasets: dict[str, Dataset] = {}
        self._aliases: dict[str, str] = {}

    def add(self, dataset: Dataset, *aliases: str) -> None:
        self._datasets[dataset.name] = dataset
        self._aliases.update({a.lower(): dataset.name for a in (dataset.name, *aliases)})

    def resolve(self, name: str) -> Dataset:
        try:
            return self._datasets[self._aliases[name.lower()]]
        except KeyError:
            raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(self._datasets))}") from None

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for d in self._datasets.values():
            out.setdefault(d.domain, []).append(d.name)
        return out

    def load(self, spark: SparkSession, name: str, split: str) -> DataFrame:
        return split_scan(spark, self.resolve(name), split)


def split_scan(spark: SparkSession, dataset: Dataset, split: str) -> DataFrame:
    """A split with ids cast; "test" is the leave-one-out file where there is one."""
    if split == "val" and not dataset.has_val:
        raise ValueError(f"{dataset.name} has no validation split")
    file = "test_loo" if split == "test" and dataset.has_loo else split
    df = spark.read.parquet(f"{dataset.path}/{file}.parquet")
    return df.withColumns({c: F.col(c).cast("long") for c in ("user_id", "item_id") if c in df.columns})


def write_splits(df: DataFrame, path: str) -> None:
    """One Parquet table per value of ``split`` with user_id, item_id and ts, as ``split_scan`` reads them."""
    for (name,) in df.select("split").where("split is not null").distinct().collect():
        df.where(F.col("split") == name).select("user_id", "item_id", "ts").write.mode("overwrite").parquet(f"{path}/{name}.parquet")


STATS = "n_users long, n_items long, n_train long, n_test long, density double, density_pct double"


def listing(spark: SparkSession, registry: Registry) -> DataFrame:
    """name, domain, n_users, n_items, n_train, n_test, density (percent) and whether the data exist, a row a dataset.

    A dataset's ``dataset_stats.json`` answers for it; without one its id columns are read
    (counts of rows come from the footers). Datasets without training data are all zeros.
    """
    conf = spark._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    out = None
    for name in [n for names in registry.groups().values() for n in names]:
        d = registry.resolve(name)
        there = exists(f"{d.path}/train.parquet")
        if there and exists(f"{d.path}/dataset_stats.json"):
            row = spark.read.schema(STATS).option("multiLine", True).json(f"{d.path}/dataset_stats.json").withColumn("density", F.coalesce("density", "density_pct"))
        elif there:
            test = split_scan(spark, d, "test").agg(F.count("*").alias("n_test"))
            train = split_scan(spark, d, "train").agg(F.count("*").alias("n_train"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"))
            row = train.join(F.broadcast(test)).withColumn("density", 100 * F.col("n_train") / F.nullif(F.col("n_users") * F.col("n_items"), F.lit(0)))
        else:
            row = spark.range(1).select(*[F.lit(None).alias(c) for c in ("n_users", "n_items", "n_train", "n_test", "density")])
        counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n_users", "n_items", "n_train", "n_test")]
        row = row.select(F.lit(d.name).alias("name"), F.lit(d.domain).alias("domain"), *counts, F.coalesce(F.col("density").cast("double"), F.lit(0.0)).alias("density"), F.lit(there).alias("present"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "name string, domain string, n_users long, n_items long, n_train long, n_test long, density double, present boolean")


def raw_reviews(df: DataFrame) -> DataFrame:
    """user_id, item_id, rating, timestamp; the item is parent_asin, or asin where that is missing."""
    items = [F.col(c) for c in ("parent_asin", "asin") if c in df.columns]
    if not items:
        raise ValueError("missing columns: parent_asin or asin")
    return df.select("user_id", F.coalesce(*items).alias("item_id"), F.col("rating").cast("double").alias("rating"), F.col("timestamp").cast("long").alias("timestamp"))


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(S.RATINGS_CSV).csv(path, header=True)
    return df.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating", "timestamp")


ITEM = StructType([StructField(c, StringType()) for c in ("title", "text", "asin", "category", "subcategory", "abstract", "genres")])


def item_metadata(lines: DataFrame, width: int | None = None) -> DataFrame:
    """item_id and fields of JSON objects keyed by id (column ``value``); text cut to ``width``."""
    rows = lines.select(F.explode(F.from_json("value", MapType(StringType(), ITEM))).alias("id", "m")).select(F.col("id").cast("long").alias("item_id"), "m.*")
    return rows.withColumn("text", F.substring("text", 1, width)) if width else rows


def metadata_from_titles(rows: DataFrame, order: list[str]) -> DataFrame:
    """item_id, title of the first row per item in a total order."""
    return rows.groupBy("item_id").agg(F.min_by("title", F.struct(*order)).alias("title"))


def news(lines: DataFrame) -> DataFrame:
    """id, category, subcategory, title, abstract, text of tab-separated lines (column ``value``) with five fields or more."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 5)
    names = ("news_id", "category", "subcategory", "title", "abstract")
    return rows.select(*[F.element_at(f, i + 1).alias(n) for i, n in enumerate(names)]).withColumn("text", F.concat_ws(". ", "title", "abstract"))


def behaviours(lines: DataFrame) -> DataFrame:
    """raw_user, raw_item, ts of clicked impressions and of the history before them.

    History item i of n gets the time t - n + i; a time that can't be read is 0.
    """
    f = F.split("value", "\t")
    t = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.element_at(f, 3), F.lit("M/d/yyyy h:mm:ss a"))), F.lit(0))
    rows = lines.where(F.size(f) >= 5).select(F.element_at(f, 2).alias("raw_user"), t.alias("t"), F.filter(F.split(F.element_at(f, 4), " "), lambda x: x != "").alias("history"), F.split(F.element_at(f, 5), " ").alias("shown"))
    clicked = rows.select("raw_user", F.explode("shown").alias("x"), F.col("t").alias("ts")).select("raw_user", F.regexp_extract("x", "^(.*)-1$", 1).alias("raw_item"), "ts").where("raw_item <> ''")
    past = rows.select("raw_user", "t", F.size("history").alias("n"), F.posexplode("history").alias("i", "raw_item")).select("raw_user", "raw_item", (F.col("t") - F.col("n") + F.col("i")).alias("ts"))
    return clicked.unionByName(past)
