"""Operator 6: language ID by compression.

``fit`` gathers, for each language, a raw-content zstandard dictionary from labelled texts. ``classify`` encodes a text,
chunk by chunk over its whole length, with every language's dictionary; the language whose encoding is smallest wins. If the next
best is hardly larger, the text is rejected (the margin is a share of the best encoding's size, and some bytes at least).

Scale: one scan and no shuffle of texts. The fit reads a bounded sample: the ``SAMPLE_DOCS`` labelled texts of each language with
the least hashes, whatever their length and however many there are; of a long one a slice of a sixteenth of ``DICT_BYTES``
from a hashed offset. The last ``DICT_BYTES`` of the slices become the dictionary that is broadcast.

Defined results: null texts and texts without a letter are ``und`` with score 0 and count as rejected; ties go to the language
with more labelled rows, then by name; without any labelled text all are ``und``; of more than ``MOST_LANGUAGES`` languages those with the most labelled rows are learned; rows without a language and empty texts
teach nothing; a row repeated under one id is drawn once; repeated rows are judged one by one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_text, map_rows, text_bytes
from .words import LOWER

#: Texts sampled for each language, bytes of its dictionary, and of a text encoded at once.
SAMPLE_DOCS, DICT_BYTES, CHUNK, LEVEL = 300, 64 << 10, 512, 6
#: A model learns at most this many languages, those with the most labelled rows: every text is encoded once for each.
MOST_LANGUAGES = 200
#: Range of the draw of texts.
DRAWS = 1 << 40
#: Shorter texts are encoded as three lines of themselves: alone they would often be stored as they are, a tie.
SHORT = 160
#: A text is rejected if the next best language's encoding is larger by less than this share of the best one, or by fewer bytes.
#: Set from held-out texts whose language was left out of the model, beside those whose language was in it (README).
MARGIN, FLOOR = 0.02, 3
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Model:
    """Languages, those with more labelled rows first, and their dictionaries."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.contents:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or not raw.isascii() and any(c.isalpha() for c in raw.decode())


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, most: int = MOST_LANGUAGES) -> Model:
    """A model from the labelled rows for which train holds."""
    rows = docs.filter(train).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    row = F.xxhash64("doc_id", "text", F.lit(7))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(F.octet_length("text") > 0, row)).alias("distinct")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not found:
        return Model((), ())
    # The draw passes about one and a half times the rows wanted, so that the least draws are all among them; one row for each language.
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.5 * sample_docs / max(r.distinct, 1))) for r in found], rows.select("lang", F.lit(0.0).alias("share")).schema))
    raw, bound = F.col("text").cast("binary"), F.lit(dict_bytes // 16)
    offset = F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.greatest(F.octet_length("text") - bound, F.lit(0)) + 1).cast("int")
    drawn = rows.join(shares, "lang").withColumn("draw", F.pmod(row, F.lit(DRAWS))).filter((F.octet_length("text") > 0) & (F.col("draw") < F.col("share") * DRAWS))
    pieces: dict[str, list[tuple[int, bytes]]] = {}
    for r in drawn.select("lang", "draw", F.substring(raw, offset + 1, bound).alias("piece")).distinct().collect():
        pieces.setdefault(r.lang, []).append((r.draw, bytes(r.piece)))
    names, contents = [], []
    for lang in (r.lang for r in found):
        mine = sorted(pieces.get(lang, []))[:sample_docs]
        # A slice may begin or end within a character.
        content = b"\n".join(t.decode(errors="ignore").encode().translate(LOWER) for _, t in mine)[-dict_bytes:]
        if content:
            names.append(lang)
            contents.append(content if len(content) >= 8 else (content + b"\n") * 8)
    return Model(tuple(names), tuple(contents))


def judge(raw: bytes, names: tuple[str, ...], encoders: list, margin: float = MARGIN) -> tuple[str, float, bool]:
    """Language, score and whether the margin was too narrow."""
    if not names or not raw or not has_letter(raw):
        return "und", 0.0, True
    low = raw.translate(LOWER)
    if len(low) < SHORT:
        low = (low + b"\n") * 3
    sizes = [0] * len(names)
    for a in range(0, len(low), CHUNK):
        chunk = low[a : a + CHUNK]
        for k, e in enumerate(encoders):
            sizes[k] += len(e.compress(chunk))
    best = min(sizes)
    k = sizes.index(best)
    others = sorted(sizes[:k] + sizes[k + 1 :])
    # A byte more halves a language's weight.
    score = 1.0 / (1.0 + sum(2.0 ** -min(s - best, 60) for s in others))
    return names[k], score, bool(others) and others[0] - best < max(margin * best, FLOOR)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1), rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, encoders = held.value.names, _encoders(held.value)
        found = [judge(raw, names, encoders, margin) for raw in text_bytes(batch)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found])], ["doc_id", "lang_pred", "score", "rejected"])

    return id_text(docs, id_col, text_col).mapInArrow(map_rows(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_column(docs: DataFrame, model: Model, name: str, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs, all columns, with a boolean column name: false where the text is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, encoders = held.value.names, _encoders(held.value)
        keep = pa.array([not judge(raw, names, encoders, margin)[2] for raw in text_bytes(batch, text_col)])
        return pa.RecordBatch.from_arrays([*batch.columns, keep], [*batch.schema.names, name])

    return docs.mapInArrow(map_rows(run), docs.withColumn(name, F.lit(True)).schema)


_MADE: dict[int, list] = {}


def _encoders(model: Model) -> list:
    """A worker's encoders of the model it used last."""
    key = hash(model)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = model.encoders()
    return _MADE[key]
