"""Map-reduce over the windows of long texts with a model of one's choice, as an ordered tree.

A model is a function from a list of prompts to a list of replies, called on batches inside tasks. Every
window's reply is parsed into a partial insight; partials that follow one another are put to the reducing
model as one JSON array, FAN_IN at a time, until each text has one left. Groups are shuffled by (text, group),
so the windows of one very long text are spread over tasks, and a task never holds more than FAN_IN partials
of it. Each level is a written table: a lost executor repeats no model call of an earlier level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom import storage
from cueloom.plans.library import partial_insight

Model = Callable[[list[str]], list[str]]
FAN_IN, BATCH = 8, 16
PARSE_FAILED, MODEL_FAILED = "PARTIAL_INSIGHT_PARSE_FAILED", "MODEL_FAILED"


def ask(prompts: DataFrame, model: Model, batch: int = BATCH) -> DataFrame:
    """prompts (..., prompt) with `reply` and `error` in place of prompt. Rows without a prompt aren't asked.

    Where the model fails on a batch, its prompts are put to it one by one, so that only those at fault have an error.
    """
    kept = [f for f in prompts.schema.fields if f.name != "prompt"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["reply string", "error string"])

    def one_by_one(texts: list[str]) -> Iterator[tuple[str | None, str | None]]:
        for t in texts:
            try:
                yield model([t])[0], None
            except Exception as e:  # noqa: BLE001  (whatever a model raises is that window's result)
                yield None, f"{MODEL_FAILED}: {type(e).__name__}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = [i for i, p in enumerate(f["prompt"]) if p is not None]
            got: dict[int, tuple[str | None, str | None]] = {}
            for at in range(0, len(asked), batch):
                places = asked[at : at + batch]
                texts = [f["prompt"].iat[i] for i in places]
                try:
                    replies: list = [(r, None) for r in model(texts)]
                    if len(replies) != len(texts):
                        raise ValueError("a reply for each prompt is needed")
                except Exception:  # noqa: BLE001
                    replies = list(one_by_one(texts))
                got |= dict(zip(places, replies, strict=True))
            f = f.drop(columns="prompt")
            f["reply"] = [got.get(i, (None, None))[0] for i in range(len(f))]
            f["error"] = [got.get(i, (None, None))[1] for i in range(len(f))]
            yield f

    return prompts.mapInPandas(run, schema)


def _settled(rows: DataFrame) -> DataFrame:
    path = storage.shared_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def map_reduce(windows: DataFrame, mapper: Model, reducer: Model, fan_in: int = FAN_IN) -> DataFrame:
    """windows (key, idx, text; idx from 0 without gaps) -> key, windows, failed, error, insight (summary, bullets, chapters).

    A text of one window has its partial as its insight. A text any of whose windows or groups failed has no
    insight; `failed` says how many did, `error` is that of the first. A null text is an empty one; a repeated
    (key, idx) is an error of the caller's.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    asked = ask(windows.select("key", F.col("idx").cast("long").alias("pos"), F.coalesce("text", F.lit("")).alias("prompt")), mapper)
    level = _settled(_parsed(asked.withColumn("failed", F.lit(0).cast("long"))))
    sizes = level.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"))
    level = level.join(sizes, level["key"].eqNullSafe(sizes["of"])).drop("of").withColumn("windows", F.col("n"))
    left = sizes.agg(F.max("n")).first()[0] or 0
    done = [level.where("n = 1")]
    level = level.where("n > 1")
    while left > 1:
        groups = level.groupBy("key", F.floor(F.col("pos") / fan_in).cast("long").alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "insight"))).alias("p"), F.sum("failed").alias("failed"),
            F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"), F.first("n").alias("n"), F.first("windows").alias("windows"),
        )
        alone = F.size("p") == 1
        prompt = F.when(~alone & (F.col("failed") == 0), F.to_json(F.transform("p", lambda x: x["insight"])))
        kept = groups.select("key", "pos", "windows", F.ceil(F.col("n") / fan_in).cast("long").alias("n"), "failed", F.col("error").alias("before"), F.when(alone, F.col("p")[0]["insight"]).alias("kept"), prompt.alias("prompt"))
        level = _settled(_parsed(ask(kept, reducer)))
        done.append(level.where("n = 1"))
        level = level.where("n > 1")
        left = -(-left // fan_in)
    out = done[0].select("key", "windows", "failed", "error", "insight")
    for d in done[1:]:
        out = out.unionByName(d.select("key", "windows", "failed", "error", "insight"))
    return out


def _parsed(asked: DataFrame) -> DataFrame:
    """Replies as partial insights; a reply that can't be parsed is a failure. Groups that weren't asked keep what they had."""
    before = F.col("before") if "before" in asked.columns else F.lit(None).cast("string")
    kept = F.col("kept") if "kept" in asked.columns else F.lit(None)
    x = asked.withColumn("parsed", partial_insight(F.col("reply")))
    wrong = F.when(F.col("reply").isNotNull() & F.col("parsed").isNull(), PARSE_FAILED)
    error = F.coalesce(before, "error", wrong)
    new = F.col("error").isNotNull() | wrong.isNotNull()
    x = x.withColumn("insight", F.coalesce("parsed", kept)).withColumn("failed", F.col("failed") + new.cast("long")).withColumn("error", error)
    return x.drop("reply", "parsed", "before", "kept")
