"""Problem 7: fill containers of a fixed capacity with texts of varying length.

Lengths are tokens of a public tokenizer. A text longer than the capacity is cut into full
containers and one rest; nothing else is split. The items of a capacity are cut by hash into
groups of about ``group_tokens`` tokens; every group is filled by minimum bin slack: a container
is opened by the largest item left, and the multiset of remaining lengths that comes closest
to the rest of the window is found by a subset-sum over a bitset (one big integer whose bit s
says that sum s can be reached), counts in powers of two, and traced back. A filling is reused
as often as the counts allow. A group wastes at most its last containers, so the loss does not
grow with the number of groups in proportion to the data.

Defined results: null and blank texts have no tokens and need no container: they are returned
with a null container; repeated texts are items each; a null or non-positive capacity gives
no rows; equal lengths are taken by document id; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _counter(tokenizer: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for pdf in batches:
            n = np.zeros(len(pdf), dtype=np.int64)
            at = [i for i, t in enumerate(pdf["text"]) if t and t.strip()]
            for s in range(0, len(at), 256):
                part = at[s : s + 256]
                got = tok.encode_batch_fast([pdf["text"].iloc[i] for i in part], add_special_tokens=False)
                n[part] = [len(e) for e in got]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n})

    return count


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document, whole texts."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInPandas(_counter(tokenizer), "doc_id bigint, n_tokens bigint")


def best_filling(window: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of ``lengths`` (in decreasing order, at most ``counts`` each) whose sum is
    the largest not above ``window``."""
    mask = (1 << (window + 1)) - 1
    goal = 1 << window
    reach, steps = 1, []
    for length in lengths:
        if length > window:
            continue
        left = min(counts[length], window // length)
        k = 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not (before >> total) & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
        if total == 0:
            break
    return used


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every length is between 1 and ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    counts = {n: len(s) for n, s in stacks.items()}
    open_lengths = sorted(counts, reverse=True)
    out = np.zeros(len(lengths), dtype=np.int64)
    container, first = 0, 0
    while first < len(open_lengths):
        largest = open_lengths[first]
        if not counts[largest]:
            first += 1
            continue
        if len(open_lengths) > 64 and sum(1 for n in open_lengths[first:] if not counts[n]) * 2 > len(open_lengths) - first:
            open_lengths, first = [n for n in open_lengths[first:] if counts[n]], 0
        counts[largest] -= 1
        window = capacity - largest
        filling = best_filling(window, [n for n in open_lengths[first:] if counts[n]], counts) if window else {}
        counts[largest] += 1
        filling[largest] = filling.get(largest, 0) + 1
        for _ in range(min(counts[n] // k for n, k in filling.items())):
            for n, k in filling.items():
                for _ in range(k):
                    out[stacks[n].pop()] = container
                counts[n] -= k
            container += 1
    return out


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity_tokens"].iloc[0])
    number = minimum_bin_slack(pdf["n_tokens"].to_numpy(), capacity)
    pdf["container"] = (int(pdf["grp"].iloc[0]) << 32) + number
    return pdf[["limit_id", "capacity_tokens", "container", "doc_id", "piece", "start_token", "n_tokens"]]


def pack(docs: DataFrame, limits: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, group_tokens: int = 4_000_000) -> DataFrame:
    """One row per placed piece: limit_id, capacity_tokens, container, doc_id, piece,
    start_token, n_tokens."""
    counts = materialize(token_counts(docs, doc_id, text, tokenizer), "tokens")
    caps = [(r.limit_id, r.capacity_tokens) for r in limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().collect()]  # the capacities asked for
    spark = docs.sparkSession
    schema = "limit_id bigint, capacity_tokens bigint, container bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint"
    if not caps:
        return spark.createDataFrame([], schema)
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("limit_id"), F.lit(c).cast("bigint").alias("capacity_tokens")) for i, c in caps]))
    wanted = counts.select("doc_id", F.col("n_tokens").alias("size"), each.alias("l")).select("doc_id", "size", "l.*")
    pieces = wanted.where("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / F.col("capacity_tokens")) - 1).cast("int"))))
    start = F.col("piece").cast("bigint") * F.col("capacity_tokens")
    pieces = pieces.withColumn("start_token", start).withColumn("n_tokens", F.least(F.col("capacity_tokens"), F.col("size") - start)).drop("size")
    items = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    placed = items.groupBy("limit_id", "capacity_tokens", "grp").applyInPandas(_fill, schema)
    nothing = wanted.where("size = 0").select("limit_id", "capacity_tokens", F.lit(None).cast("bigint").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.col("size").alias("n_tokens"))
    return placed.unionByName(nothing)


def fill_rate(placed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of unused space of each capacity."""
    per = placed.where("container IS NOT NULL").groupBy("limit_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("used"))
    n, used = F.count(F.lit(1)), F.sum("used")
    return per.groupBy("limit_id", "capacity_tokens").agg(n.alias("n_containers"), used.alias("n_tokens"), (1 - used / (n * F.col("capacity_tokens"))).alias("unused_share"))
