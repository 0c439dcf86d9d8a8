"""External boundaries: model calls, embeddings, tokenizing and segmentation, each behind an injected function.

A function is built once for each task from a factory, so a client or model is loaded where it is used. Tasks can be
repeated, so calls happen at least once: write the result before filtering it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions import text as X


def call_model(rows: DataFrame, prompt: str, make: Callable[[], Callable[[Sequence[str]], Sequence[str | None]]], answer: str = "answer", batch: int = 32) -> DataFrame:
    """Rows with a model's answer to their prompt; an error is for the function to return as null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            prompts = list(pdf[prompt])
            yield pdf.assign(**{answer: [a for k in range(0, len(prompts), batch) for a in ask(prompts[k : k + batch])]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, `{answer}` string")


def embed(rows: DataFrame, text: str, make: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], vector: str = "embedding") -> DataFrame:
    """Rows with a vector of their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            yield pdf.assign(**{vector: [list(map(float, v)) for v in encode(list(pdf[text]))]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, `{vector}` array<float>")


def segment(rows: DataFrame, text: str, make: Callable[[], Callable[[str], Sequence[str]]], out: str = "sentences") -> DataFrame:
    """Rows with the sentences of an injected segmenter; ``functions.text.split_sentences`` is the built-in one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = make()
        for pdf in batches:
            yield pdf.assign(**{out: [list(part(t)) if t else [] for t in pdf[text]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, `{out}` array<string>")


def word_sentences(text: Column | str, language: str = "en", country: str = "CA") -> Column:
    """Sentences of a text, each as its words, by the platform's own break rules for a language; runs inside the JVM."""
    return F.sentences(X.or_empty(text), F.lit(language), F.lit(country))


def token_count(text: Column | str) -> Column:
    """Words between white space, a stand-in for a tokenizer's length."""
    bare = X.spaces(X.or_empty(text))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def chat_text(prompt: Column | str, completion: Column | str, end: str = "</s>") -> Column:
    """Prompt and answer as one training text."""
    return X.with_end(F.concat_ws("\n", X.or_empty(prompt), X.or_empty(completion)), end)


def inference_rows(pairs: DataFrame) -> DataFrame:
    """What batch inference reports beside the generated text: id with a default, truth, prompt length."""
    return pairs.select(F.coalesce(F.nullif(F.col("metadata.claim_id"), F.lit("")), F.concat(F.lit("item_"), F.col("pair_id").cast("string"))).alias("claim_id"), F.col("completion").alias("ground_truth"), F.length(X.or_empty("prompt")).alias("prompt_length"))


def verification_stub(claim: Column | str) -> Column:
    """The placeholder of an external check: the claim, unverified, without sources."""
    return F.struct(X._col(claim).alias("claim"), F.lit(False).alias("verified"), F.array().cast("array<string>").alias("sources"))
