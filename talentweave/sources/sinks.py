"""Writers of graphs, processed tables, metrics, prediction samples and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import capped_by_order


def write_graph(graph: dict[str, DataFrame], folder: str, csv: bool = True) -> None:
    """Nodes, edges and statistics as Parquet, and as CSV with a header when asked for."""
    for name, table in graph.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        if csv:
            # the rows just written: a table is computed once
            rows = table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")
            rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}_csv")


def write_processed(tables: dict[str, DataFrame], folder: str) -> None:
    """Processed tables as Parquet, interactions partitioned by split, run metadata as JSON."""
    for name, table in tables.items():
        if name == "meta":
            table.write.mode("overwrite").json(f"{folder}/{name}")
        elif name == "interactions":
            table.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def metrics_table(*rows: DataFrame) -> DataFrame:
    """Metric rows of several models under the sorted union of their columns; missing cells are NULL."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return union.select(*[F.col(f"`{c}`") for c in sorted(union.columns)])


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """Metrics as CSV (missing cells blank) and JSON."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics_csv")
    metrics.write.mode("overwrite").json(f"{folder}/metrics_json")


def prediction_sample(rankings: DataFrame, users: int = 5, jobs: int = 10) -> DataFrame:
    """(user_id, job_ids): the first jobs of the first users, for inspection."""
    chosen = capped_by_order(rankings.where(F.col("rank") == 1).select("user_id"), users, ["user_id"])
    top = rankings.where(F.col("rank") <= jobs).join(F.broadcast(chosen), "user_id", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))), lambda e: e["job_id"])
    return top.groupBy("user_id").agg(listed.alias("job_ids"))


def write_prediction_sample(rankings: DataFrame, path: str, users: int = 5, jobs: int = 10) -> None:
    prediction_sample(rankings, users, jobs).write.mode("overwrite").json(path)


def write_user_ndcg(ndcg: DataFrame, path: str) -> None:
    """(model, seed, user_id, ndcg) partitioned by model and seed, sorted by user inside each file."""
    ndcg.sortWithinPartitions("user_id").write.mode("overwrite").partitionBy("model", "seed").parquet(path)


def explanation_json(explained: DataFrame, *columns: str) -> DataFrame:
    """One JSON document per explained pair."""
    picked: list[Column | str] = list(columns) or explained.columns
    return explained.select(F.to_json(F.struct(*picked)).alias("value"))


def write_explanations(explained: DataFrame, path: str, *columns: str) -> None:
    """One JSON document per explained pair and line, compressed: payloads repeat most of their words."""
    explanation_json(explained, *columns).write.mode("overwrite").option("compression", "gzip").text(path)
