"""Token arrays: encoding by a pluggable tokenizer, supervised examples, padding and collation."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

IGNORED = -100


def encoder(make: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """An Arrow UDF from text to ids; make builds the tokenizer once for each worker batch stream."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = make()
        for s in texts:
            yield s.map(lambda t: tokenize(t) if t is not None else None)

    return encode


def decoder(make: Callable[[], Callable[[list[int]], str]]) -> Callable[[Column], Column]:
    """An Arrow UDF from ids to text."""

    @F.pandas_udf(StringType())
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = make()
        for s in ids:
            yield s.map(lambda x: back([int(i) for i in x]) if x is not None else None)

    return decode


#: Characters that are encoded at once.
PIECE = 1 << 18


@cache
def _loaded(path: str):
    """A file's tokenizer, once in each process, however many columns it encodes."""
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer from a file of the tokenizers library, which all executors must see; without a pad token, the end token pads."""

    path: str
    bos: str | None = None
    eos: str | None = None
    pad: str | None = None

    def load(self):
        return _loaded(self.path)

    def id_of(self, name: str | None) -> int | None:
        return None if name is None else self.load().token_to_id(name)

    @property
    def pad_id(self) -> int | None:
        return self.id_of(self.pad or self.eos)

    def encode(self, text: Column) -> Column:
        """Ids of each text, a piece of a batch at a time."""

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield pd.Series([None if e is None else np.array(e.ids, np.int32) for e in self._encodings(s)], dtype=object)

        return encode(text)

    def count(self, text: Column) -> Column:
        """Tokens of each text; null for null. Ids are counted where they are made."""

        @F.pandas_udf(IntegerType())
        def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in texts:
                yield pd.Series([None if e is None else len(e) for e in self._encodings(s)], dtype="Int32")

        return count(text)

    def _encodings(self, texts: pd.Series) -> Iterator:
        """An encoding (null for null) of each text; the library's encodings take many times the texts' memory, so few are held."""
        # Spark's tasks already use the cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = _loaded(self.path)
        at, values = 0, texts.tolist()
        while at < len(values):
            end, held = at, 0
            while end < len(values) and (end == at or held + len(values[end] or "") <= PIECE):
                held += len(values[end] or "")
                end += 1
            part = values[at:end]
            found = iter(tokenizer.encode_batch_fast([t for t in part if t is not None], add_special_tokens=False))
            for t in part:
                yield None if t is None else next(found)
            at = end

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        def make():
            tokenizer = self.load()
            return lambda x: tokenizer.decode(x, skip_special_tokens=skip_special)

        return decoder(make)(ids)


def word_ids(c: Column, modulus: int = 32_000) -> Column:
    """A native toy tokenizer: each word's MD5 as an id; for tests and plans without a vocabulary."""
    words = F.filter(F.split(c, "[ \\n]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % modulus + 3).cast("int"))


def framed(ids: Column, bos: int | None = None, eos: int | None = None, most: int | None = None) -> Column:
    """ids with optional begin and end ids, cut to most."""
    out = F.concat(*([F.array(F.lit(bos))] if bos is not None else []), ids, *([F.array(F.lit(eos))] if eos is not None else []))
    return F.slice(out, 1, most) if most is not None else out


def supervised(prompt: Column, response: Column, most: int, bos: int | None = 1, eos: int | None = 2) -> Column:
    """struct(input_ids, labels, exceeding_length): the prompt's labels are ignored; the flag is judged before the cut."""
    a, b = framed(prompt, bos=bos), framed(response, eos=eos)
    ids = F.concat(a, b)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(a)), b)
    return F.struct(F.slice(ids, 1, most).alias("input_ids"), F.slice(labels, 1, most).alias("labels"), (F.size(ids) > most).alias("exceeding_length"))


def padded(ids: Column, size: Column | int, pad: int, left: bool = False) -> Column:
    more = F.array_repeat(F.lit(pad), F.greatest((F.lit(size) if isinstance(size, int) else size) - F.size(ids), F.lit(0)))
    return F.concat(more, ids) if left else F.concat(ids, more)


def collate(rows: DataFrame, batch: str, pad: int, all_ones: bool = False) -> DataFrame:
    """input_ids and labels padded to their batch's longest, with attention_mask (padding off, the first place always on)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    df = rows.withColumn("_n", longest)
    ids = padded(F.col("input_ids"), F.col("_n"), pad)
    mask = F.transform(ids, lambda x, i: F.lit(True) if all_ones else (x != pad) | (i == 0))
    return df.withColumns({"labels": padded(F.col("labels"), F.col("_n"), IGNORED), "attention_mask": mask, "input_ids": ids}).drop("_n")


# Context sizes by model family, named by their infilling marks.
CONTEXTS = {"fim": 8192, "pre": 16384, "begin": 16384}


def context_size(family: str) -> int:
    return CONTEXTS.get(family, 4096)


def truncated(examples: DataFrame) -> DataFrame:
    """How many supervised examples were cut, and of how many."""
    return examples.agg(F.coalesce(F.sum(F.col("exceeding_length").cast("long")), F.lit(0)).alias("truncated"), F.count("*").alias("n"))


def new_tokens(context: Column | int, used: Column, most_new: int, most: int | None = None) -> Column:
    """How many tokens may still be generated."""
    room = (F.lit(context) if isinstance(context, int) else context) - used
    return F.greatest(F.least(room, F.lit(most_new), *([F.lit(most) - used] if most is not None else [])), F.lit(0))
