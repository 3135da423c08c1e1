"""Problem 8: evaluation texts that leaked into documents.

Every run of ``min_words`` consecutive words of every test item is a pattern of one
Aho-Corasick automaton over word numbers. Each document is normalised and scanned once; every
match names the items that hold the run, and overlapping matches of an item are joined into
passages with offsets in the original text.

The automaton is built in each worker from the broadcast item words. Items are taken in
shards of a bounded number of words (``shard_words``); a set within the bound, as usual, is one
shard and one automaton, a larger one is scanned shard by shard.

Defined results: null or blank texts hold no passage; an item with fewer than ``min_words``
words has no pattern; repeated documents are reported each; a run shared by items is reported
for each of them; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import words, words_with_spans


def build_automaton(items: list[tuple[int, list[str]]], min_words: int):
    """(automaton, word numbers). Word number 0 stands for every word of no item."""
    import ahocorasick

    numbers: dict[str, int] = {}
    runs: dict[tuple[int, ...], set[int]] = {}
    for item, ws in items:
        seq = [numbers.setdefault(w, len(numbers) + 1) for w in ws]
        for i in range(len(seq) - min_words + 1):
            runs.setdefault(tuple(seq[i : i + min_words]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for run, owners in runs.items():
        automaton.add_word(run, tuple(sorted(owners)))
    if runs:
        automaton.make_automaton()
    return (automaton if runs else None), numbers


def passages(ws: list[str], automaton, numbers: dict[str, int], min_words: int) -> dict[int, list[list[int]]]:
    """item -> joined [first word, last word] ranges."""
    out: dict[int, list[list[int]]] = {}
    if automaton is None or len(ws) < min_words:
        return out
    seq = tuple(numbers.get(w, 0) for w in ws)
    for end, owners in automaton.iter(seq):
        for item in owners:
            spans = out.setdefault(item, [])
            if spans and end - min_words <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([end - min_words + 1, end])
    return out


def _scanner(items, min_words: int, with_spans: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, numbers = build_automaton(items.value, min_words)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["__id"], pdf["__text"], strict=True):
                if not text:
                    continue
                found = passages(words(text), automaton, numbers, min_words)
                if not found:
                    continue
                if not with_spans:
                    rows.extend((doc, item, sum(b - a + 1 for a, b in spans), None, None) for item, spans in found.items())
                    continue
                placed = words_with_spans(text)
                again = passages([w for w, _, _ in placed], automaton, numbers, min_words)
                for item, spans in found.items():
                    spans = again.get(item, [])
                    if not spans:  # no offsets for this passage
                        rows.append((doc, item, None, None, None))
                    rows.extend((doc, item, b - a + 1, placed[a][1], placed[b][2]) for a, b in spans)
            yield pd.DataFrame(rows, columns=["__id", "__item", "n_words", "start", "end"]).astype({"n_words": "Int64", "start": "Int64", "end": "Int64"})

    return scan


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, shard_words: int = 2_000_000, with_spans: bool = False) -> DataFrame:
    """(doc_id, item_id, n_words) per leaked item, or one row per passage with offsets."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where("__text IS NOT NULL")
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-size // (5 * shard_words)))
    id_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    parts = []
    for s in range(shards):
        rows = wanted.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == s).collect()  # bounded by shard_words
        known = spark.sparkContext.broadcast(sorted((r.i, words(r.t)) for r in rows))
        parts.append(src.mapInPandas(_scanner(known, min_words, with_spans), f"__id {id_type}, __item {item_type}, n_words bigint, start bigint, end bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    out = out.select(F.col("__id").alias(doc_id), F.col("__item").alias(item_id), "n_words", "start", "end")
    return out if with_spans else out.drop("start", "end")
