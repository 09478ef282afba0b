"""Language identification by language-bitmask n-gram filters (operator 9).

Every slot of a bit-sliced Bloom filter holds one bit per language. A byte 4-gram of the lower-cased letters of a
text looks up ``HASHES`` slots; the AND of their masks is the set of languages that contain it. Per
language the set bits are counted over the text and corrected for false positives (the language's share of
full slots to the power ``HASHES``); the highest corrected count decides. ``score`` is that count per n-gram.

Learning reads a bounded sample: at most ``SAMPLE`` labelled documents per language (those with the smallest hash of
their id). All of their n-grams go into the filter: Spark counts the distinct ones for its size (at most ``1 << WIDEST`` slots, so that
it cannot outgrow memory; the correction for false positives holds for a full filter, too) and makes one bitmap a language. Prediction
reads every whole text and nothing but the text.

Defined results: null text or one without a letter is ``und`` with score 0; a text with letters always gets a learned
language (ties: the first by name; no known n-gram: score 0); without any labelled text that holds a letter all are
``und``; documents without an id teach nothing and are predicted as not held out (crc32 of a null is null); repeated rows are
each predicted; of rows with an equal id one text teaches; long texts are read whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common as C

#: Labelled documents per language, hashes per n-gram, bits of a slot's number.
SAMPLE, HASHES, WIDEST = 1_000, 3, 20
#: A text whose best language knows a smaller share of its n-grams has none: far below the scores of held-out documents (see the tests).
LEAST = 0.2

#: Characters that are looked at together.
SLICE = 1 << 18

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of all texts and the number of each text; blanks stand around every text."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b"   " for t in texts]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    grams = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:] if len(raw) > 3 else np.empty(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), n)[: len(grams)]
    plain = (grams & np.uint32(0xFFFF) != np.uint32(0x2020)) & (grams & np.uint32(0xFFFF00) != np.uint32(0x202000)) & (grams & np.uint32(0xFFFF0000) != np.uint32(0x20200000))
    return grams[plain], owner[plain]


def _slots(grams: np.ndarray, mask: int) -> list[np.ndarray]:
    h = C.mix(grams.astype(np.uint64) + C.GOLDEN)
    return [((h >> np.uint64(21 * k)) & np.uint64(mask)).astype(np.int64) for k in range(HASHES)]


def size_for(n_grams: int) -> int:
    """Largest slot number of a filter of so many n-grams."""
    return (1 << max(10, min(WIDEST, (8 * n_grams).bit_length()))) - 1


class Filters:
    """The learned filters: for every plane of eight languages, a byte per slot."""

    def __init__(self, bitmaps: dict[str, bytes], mask: int):
        self.langs, self.mask = sorted(bitmaps), mask
        self.planes = np.zeros((-(-len(self.langs) // 8), mask + 1), dtype=np.uint8)
        for i, lang in enumerate(self.langs):
            bits = np.unpackbits(np.frombuffer(bitmaps[lang], dtype=np.uint8), count=mask + 1)
            self.planes[i // 8] |= bits << np.uint8(i % 8)
        full = [((self.planes[i // 8] >> np.uint8(i % 8)) & 1).mean() for i in range(len(self.langs))]
        self.false = np.minimum(np.array(full) ** HASHES, 0.99)

    @classmethod
    def of_grams(cls, grams: dict[str, np.ndarray]) -> Filters:
        mask = size_for(sum(map(len, grams.values())))
        bits = {lang: np.zeros(mask + 1, dtype=np.uint8) for lang in grams}
        for lang, g in grams.items():
            for s in _slots(g, mask):
                bits[lang][s] = 1
        return cls({lang: np.packbits(b).tobytes() for lang, b in bits.items()}, mask)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; about ``SLICE`` characters are looked at together."""
        names, scores, lo, size = [], [np.zeros(0)], 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= SLICE or hi == len(texts):
                part, score = self._predict(texts[lo:hi])
                names += part
                scores.append(score)
                lo, size = hi, 0
        return names, np.concatenate(scores)

    def _predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        read = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], dtype=bool)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs or not read.any():
            return names, score
        where = np.flatnonzero(read)
        grams, owner = _grams([texts[i] for i in where])
        slots = _slots(grams, self.mask)
        count = np.zeros((len(where), len(self.langs)))
        for p, plane in enumerate(self.planes):
            have = plane[slots[0]]
            for s in slots[1:]:
                have &= plane[s]
            by = np.bincount(owner * 256 + have, minlength=len(where) * 256).reshape(len(where), 256)
            for i in range(p * 8, min(len(self.langs), p * 8 + 8)):
                count[:, i] = by @ (np.arange(256) >> (i % 8) & 1)
        n = np.maximum(1, np.bincount(owner, minlength=len(where)))
        share = np.clip((count / n[:, None] - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(axis=1)
        score[where] = share[np.arange(len(where)), best]
        for i, b in zip(where, best):
            names[i] = self.langs[b]
        return names, score


def _distinct_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs = np.array(batch.column(1).to_pylist(), dtype=object)
    grams, owner = _grams(batch.column(0).to_pylist())
    out = [(lang, np.unique(grams[(langs == lang)[owner]])) for lang in sorted(set(langs.tolist()))]
    names = pa.array([lang for lang, v in out for _ in range(len(v))], type=pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([np.empty(0, np.int64), *(v.astype(np.int64) for _, v in out)]))], names=["lang", "gram"])


def _bitmap(mask: int):
    """Slots of one language's n-grams, which come in pieces, as bits."""

    def run(batches):
        bits: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, grams = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            for lang in set(langs.tolist()):
                mine = bits.setdefault(lang, np.zeros(mask + 1, dtype=np.uint8))
                for s in _slots(grams[langs == lang], mask):
                    mine[s] = 1
        for lang, mine in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.packbits(mine).tobytes()], type=pa.binary())], names=["lang", "bits"])

    return run


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from ``labelled`` (doc_id, text, lang); at most ``sample`` documents a language.

    A language's rows are first thinned to those whose hash lies below the place where about twice the sample is expected,
    so that no task ranks all rows of a frequent language.
    """
    known = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.expr(f"cast({1 << 30} * least(1.0, {2 * sample + 100} / n) as long)").alias("below"))
    thin = known.join(F.broadcast(rows), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("below")).select("lang", "h", "doc_id")  # one row a language
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = thin.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("lang", "doc_id")
    texts = known.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("text", "lang")  # at most `sample` rows a language
    grams = C.stored(C.map_arrow(texts, _distinct_batch, "lang string, gram long").distinct())
    mask = size_for(grams.count())
    parts = grams.repartition("lang").mapInArrow(_bitmap(mask), "lang string, bits binary")
    # a bitmap a language, of a fixed size
    return Filters({r.lang: bytes(r.bits) for r in parts.collect()}, mask)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = sent.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the labelled rows that are not held out."""
    filters = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def undetermined_removed(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the texts that have no language: ``und``, or a score under ``least``. No row is shuffled.

    Texts of one Arrow batch are looked at in slices. Null and empty texts, and texts without a letter, go; repeated rows and
    rows without an id are each judged by their text; an empty table stays empty; columns keep names and values.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out()).select("doc_id", "text", "lang")))

    def kept(texts: pa.Array) -> np.ndarray:
        names, score = sent.value.predict(texts.to_pylist())
        return np.array([n != "und" and s >= least for n, s in zip(names, score)], dtype=bool)

    return C.where_texts(docs, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.documents_of(spark, sf_dir))
