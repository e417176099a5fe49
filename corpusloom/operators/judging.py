"""Pools, judgement requests and responses, relevance judgements."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import ship

log = logging.getLogger(__name__)
LABELS = (0, 1, 2, 3)


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs one below the other, each with its place as ``run``."""
    return reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])


def pool(runs: DataFrame, k: int, run: str = "run") -> DataFrame:
    """qid, docnos: of each query the distinct documents among the top k of any run, sorted."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy(run, "qid").orderBy(F.col("score").desc(), F.col("docno"))
    top = runs.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return top.groupBy("qid").agg(F.array_sort(F.collect_set("docno")).alias("docnos"))


def pool_size(pools: DataFrame) -> DataFrame:
    return pools.agg(F.coalesce(F.sum(F.size("docnos")), F.lit(0)).cast("long").alias("size"))


def requests(pools: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """qid and request, a struct of the query and its candidates with their texts, in the pool's order.

    ``queries``: qid, text. ``documents``: docno, text. See ``unknown_ids`` for ids without either.
    """
    rows = pools.select("qid", F.posexplode("docnos").alias("at", "docno"))
    texts = rows.join(documents.select("docno", F.col("text").alias("segment")), "docno")
    candidate = F.struct("at", F.struct(F.col("docno").alias("docid"), F.struct("segment").alias("doc")).alias("c"))
    found = texts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(candidate)), lambda x: x["c"]).alias("candidates"))
    query = F.struct(F.col("qid"), F.col("text"))
    return found.join(queries.select("qid", "text"), "qid").select("qid", F.struct(query.alias("query"), "candidates").alias("request"))


def unknown_ids(pools: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """kind, id: pooled queries and documents that don't exist. Requests are made only if there are none."""
    docs = pools.select(F.explode("docnos").alias("docno")).distinct().join(documents, "docno", "left_anti")
    qids = pools.select("qid").join(queries, "qid", "left_anti")
    return docs.select(F.lit("document").alias("kind"), F.col("docno").cast("string").alias("id")).unionByName(qids.select(F.lit("query").alias("kind"), F.col("qid").cast("string").alias("id")))


def judge(asked: DataFrame, model: Callable[[dict], list[dict]]) -> DataFrame:
    """qid, labels: what a model says of each request (qid, request), in the order of the candidates.

    ``model`` takes a request as a dict and gives for each candidate a dict with label and record, a JSON
    text of its own. It is called in the workers, once for each request; a call that fails gives null labels.
    Of labels that aren't integers, such as booleans, nulls are made, which ``invalid_responses`` reports.
    """
    ship(asked.sparkSession)
    whole = lambda x: x if type(x) is int else None  # noqa: E731  a boolean is no label

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said: list[str | None] = []
            for request in batch["request"]:
                try:
                    said.append(json.dumps([{"label": whole(x.get("label")), "record": x.get("record")} for x in model(json.loads(request))]))
                except Exception:
                    log.exception("a request failed")
                    said.append(None)
            yield pd.DataFrame({"qid": batch["qid"], "labels": said})

    kind = asked.schema["qid"].dataType.simpleString()
    rows = asked.select("qid", F.to_json("request").alias("request")).mapInPandas(work, f"qid {kind}, labels string")
    return rows.select("qid", F.from_json("labels", "array<struct<label:int,record:string>>").alias("labels"))


def align_responses(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, judgments: labels in the order of the candidates, with the judge's own record of each.

    ``asked``: qid, docnos. ``answers``: qid, labels, an array of structs with label and record. Lists
    of unequal length give null.
    """
    zipped = F.transform(F.arrays_zip("docnos", "labels"), lambda x: F.struct(x["docnos"].alias("docno"), x["labels"]["label"].alias("judgment"), x["labels"]["record"].alias("record")))
    return asked.join(answers, "qid").select("qid", F.when(F.size("docnos") == F.size("labels"), zipped).alias("judgments"))


def invalid_responses(pools: DataFrame, responses: DataFrame) -> DataFrame:
    """qid, problem: missing responses, other documents than asked for or in other order, labels that aren't 0 to 3."""
    both = pools.join(responses.select("qid", "judgments", F.lit(True).alias("answered")), "qid", "full_outer")
    names = F.transform("judgments", lambda x: x["docno"])
    bad_label = F.exists("judgments", lambda x: x["judgment"].isNull() | ~x["judgment"].isin(*LABELS))
    problem = (
        F.when(F.col("docnos").isNull(), "response without request").when(F.col("answered").isNull(), "missing response").when(F.col("judgments").isNull(), "no judgments")
        .when(names != F.col("docnos"), "documents differ from the request").when(bad_label, "label out of range")
    )
    return both.select("qid", problem.alias("problem")).filter(F.col("problem").isNotNull())


def stale_requests(stored: DataFrame, current: DataFrame) -> DataFrame:
    """qid of stored requests (qid, request) that aren't the ones that would be made now."""
    now = current.select("qid", F.to_json("request").alias("now"))
    return stored.select("qid", F.to_json("request").alias("then")).join(now, "qid", "left").filter(~F.col("then").eqNullSafe(F.col("now"))).select("qid")


def pending(pools: DataFrame, responses: DataFrame) -> DataFrame:
    """Pools of the queries that have no response yet."""
    return pools.join(responses.select("qid"), "qid", "left_anti")


def qrels(responses: DataFrame) -> DataFrame:
    """qid, iter, docno, rel and ``at``, the place in the pool."""
    return responses.select("qid", F.posexplode("judgments").alias("at", "j")).select("qid", F.lit(0).alias("iter"), F.col("j.docno").alias("docno"), F.col("j.judgment").alias("rel"), "at")


def label_histogram(judged: DataFrame, key: str = "qid", label: str = "rel", labels: tuple[int, ...] = LABELS) -> DataFrame:
    """A row for each key: how many of each label (c0, c1, ...), zero where none, and the total."""
    counts = [F.count_if(F.col(label) == i).alias(f"c{i}") for i in labels]
    return judged.groupBy(key).agg(*counts, F.count("*").alias("total"))


def ndcg(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg: of every judged query; documents without judgement count as 0, queries without run too."""
    gain = lambda rel, place: (F.pow(F.lit(2.0), rel) - 1) / F.log2(place + 1.0)
    rels = judged.select("qid", "docno", F.col("rel").cast("double").alias("rel"))
    got = run.filter(F.col("rank") <= k).join(rels, ["qid", "docno"]).groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    best = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("docno"))
    ideal = rels.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("place"))).alias("ideal"))
    value: Column = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(got, "qid", "left").select("qid", value.alias("ndcg"))


def accuracy(predictions: DataFrame, truths: DataFrame, key: str = "antrag", label: str = "result") -> DataFrame:
    """The share of the truths' keys for which the prediction has the same label."""
    both = truths.select(key, F.col(label).alias("_truth")).join(predictions.select(key, F.col(label).alias("_said")), key, "left")
    return both.agg(F.avg(F.when(F.col("_truth").eqNullSafe(F.col("_said")), 1.0).otherwise(0.0)).alias("accuracy"))
