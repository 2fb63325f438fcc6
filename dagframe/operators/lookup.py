"""Questions to a catalog of objects: search, stock by key, price comparison.

The catalog's place column says which of several objects with one key comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 10


def search(catalog: DataFrame, text: str | None = None, category: str | None = None, min_price: float | None = None, max_price: float | None = None, limit: int | None = LIMIT, order: str | None = None, name: str = "name", description: str = "description", category_col: str = "category", price: str = "price") -> DataFrame:
    """Objects with the text in name or description, of the category, and within the prices; those without a price pass.

    Letter case counts in neither text nor category. With a limit the first by order, at least one; without one all.
    """
    found = catalog
    if text is not None:
        found = found.where(F.coalesce(F.lower(name).contains(text.lower()), F.lit(False)) | F.coalesce(F.lower(description).contains(text.lower()), F.lit(False)))
    if category is not None:
        found = found.where(F.lower(F.coalesce(F.col(category_col), F.lit(""))) == category.lower())
    if max_price is not None:
        found = found.where(F.coalesce(F.col(price) <= max_price, F.lit(True)))
    if min_price is not None:
        found = found.where(F.coalesce(F.col(price) >= min_price, F.lit(True)))
    return found if limit is None else (found.orderBy(order) if order else found).limit(max(limit, 1))


def first_by_key(catalog: DataFrame, key: str, place: str) -> DataFrame:
    """The first object of each key, by partial aggregation."""
    rest = [c for c in catalog.columns if c != key]
    return catalog.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _asked(requests: DataFrame, catalog: DataFrame, key: str, place: str) -> DataFrame:
    """requests (pos, key) with the first object of each; what is asked for is small, so the catalog is cut down to it before it is grouped."""
    asked = requests.select(F.col("pos"), F.col(key))
    near = catalog.join(asked.select(key).distinct(), key, "left_semi")
    return asked.join(first_by_key(near, key, place).withColumn("_found", F.lit(True)), key, "left")


def check_stock(requests: DataFrame, catalog: DataFrame, key: str = "sku", place: str = "place", name: str = "name", stock: str = "stock") -> DataFrame:
    """For each request, doubled ones included: pos, key, name, stock, in_stock, or an error for an unknown key."""
    left = F.when(F.col(stock) >= 0, F.col(stock)).otherwise(0).cast("long")
    hit = F.col("_found").isNotNull()
    return _asked(requests, catalog, key, place).select("pos", key, F.when(hit, F.coalesce(F.col(name), F.lit(""))).alias("name"), F.when(hit, F.coalesce(left, F.lit(0))).alias("stock"), F.when(hit, F.coalesce(left > 0, F.lit(False))).alias("in_stock"), F.when(~hit, "SKU not found").alias("error"))


def compare_prices(requests: DataFrame, catalog: DataFrame, key: str = "sku", place: str = "place", name: str = "name", price: str = "price") -> DataFrame:
    """For each request: pos, key, name, price (0.0 for none), or an error for an unknown key."""
    hit = F.col("_found").isNotNull()
    return _asked(requests, catalog, key, place).select("pos", key, F.when(hit, F.coalesce(F.col(name), F.lit(""))).alias("name"), F.when(hit, F.coalesce(F.col(price), F.lit(0.0))).alias("price"), F.when(~hit, "SKU not found").alias("error"))


def price_extremes(compared: DataFrame, key: str = "sku") -> DataFrame:
    """One row: the first of the cheapest and the last of the dearest of what was found, or nulls."""
    known = compared.where("error is null")
    low, high = F.min(F.struct("price", "pos", key)), F.max(F.struct("price", "pos", key))
    return known.agg(low.alias("l"), high.alias("h")).select(F.col(f"l.{key}").alias("cheapest"), F.col("l.price").alias("cheapest_price"), F.col(f"h.{key}").alias("most_expensive"), F.col("h.price").alias("most_expensive_price"))


def request_rows(spark, keys: list, key: str = "sku") -> DataFrame:
    """A list of keys as (pos, key); what is no string is left out."""
    texts = [k for k in keys if isinstance(k, str)]
    return spark.createDataFrame(list(enumerate(texts)), f"pos int, {key} string")

