"""Model names and what calls cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_models(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Add priced_model: the name if it has a price, else without what follows its last dash if that has one, else the name.

    prices (model, prompt, completion) is a price list; Spark broadcasts it if its size allows.
    """
    names = prices.select(F.col("model").alias("_priced")).distinct()
    short = F.regexp_replace(model, "-[^-]*$", "")
    out = calls.join(names, F.col(model) == F.col("_priced"), "left").withColumnRenamed("_priced", "_exact")
    out = out.join(names, short == F.col("_priced"), "left")
    return out.withColumn("priced_model", F.coalesce("_exact", "_priced", F.col(model))).drop("_exact", "_priced")


def cost(prompt_price: Column, completion_price: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    return prompt_price * prompt_tokens + completion_price * completion_tokens


def with_cost(calls: DataFrame, prices: DataFrame, model: str = "model", prompt_tokens: str = "prompt_tokens", completion_tokens: str = "completion_tokens") -> DataFrame:
    """Add priced_model and cost, null for models without a price."""
    listed = prices.select(F.col("model").alias("priced_model"), F.col("prompt").alias("_prompt"), F.col("completion").alias("_completion"))
    out = normalized_models(calls, prices, model).join(listed, "priced_model", "left")
    return out.withColumn("cost", cost(F.col("_prompt"), F.col("_completion"), F.col(prompt_tokens), F.col(completion_tokens))).drop("_prompt", "_completion")
