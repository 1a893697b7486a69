"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance.

n-grams are of one to three characters of lower-cased words, a blank standing before and after each word; a character is a letter if
Unicode says so. A profile is the `top` most frequent n-grams of all training text of a language, ties in order of code points. The
distance of a document is the sum over its own `top` n-grams of the difference in rank, `top` for n-grams that the profile lacks.

Profiles are counted over every training row: each task adds up its own counts, Spark adds the tasks' counts and keeps the top ranks;
what is broadcast is at most languages x top n-grams.

Defined results: null text, text without a letter, or no training rows at all give `und` with score 0; distances that tie go to the
lesser name; the score is 1 minus the distance over the largest possible one; long texts are counted whole, in pieces.
"""
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from nearmiss.llm.textbytes import freeing, text_array, text_batches

UNKNOWN = "und"
TOP = 400
_PIECE = 1 << 20
_TWO, _THREE = np.int64(1 << 62), np.int64(-(1 << 63))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str):
    """(codes, counts) of the n-grams of a text; a code holds the characters in 20 bits each and two
    bits for their number; 0 is the blank at a word's edge (planes above the sixteenth, which hold no letters, would not fit)."""
    text = text.lower()
    found, last = [np.zeros(0, np.int64)], [0, 0]  # the two characters before the piece, blanks at the start
    for at in range(0, max(len(text), 1), _PIECE):
        points = np.frombuffer(text[at:at + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        x = np.concatenate([last, np.where(_letters()[points], points, 0), np.zeros(int(at + _PIECE >= len(text)), np.int64)])
        a, b, c = x[:-2], x[1:-1], x[2:]
        found += [c[c > 0], (b << 20 | c)[(b > 0) | (c > 0)] | _TWO, (a << 40 | b << 20 | c)[b > 0] | _THREE]
        last = x[-2:].tolist()
    return np.unique(np.concatenate(found), return_counts=True)


def top_grams(codes, counts, top: int = TOP):
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def held_out(id_column: Column) -> Column:
    """True for the rows that no model learns from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


class Profiles:
    """Rank tables of the languages."""

    def __init__(self, ranked: dict, top: int):
        self.names, self.top = sorted(ranked), top
        self.codes, self.ranks = [], []
        for name in self.names:
            codes = np.array(ranked[name], np.int64)
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.ranks.append(order)

    def classify(self, text):
        """(language, score) of one text."""
        own = top_grams(*gram_counts(text or ""), self.top)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        best = None
        for name, codes, ranks in zip(self.names, self.codes, self.ranks):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            apart = np.where(codes[at] == own, np.abs(ranks[at] - np.arange(len(own))), self.top)
            distance = int(apart.sum())
            if best is None or distance < best[0]:
                best = distance, name
        return best[1], 1.0 - best[0] / (self.top * len(own))


def learn_profiles(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, unpack=None) -> Profiles:
    """Profiles from all rows whose language is not null; unpack turns stored batches into (languages, texts) where a row holds many."""
    def count(batches):
        held: dict = {}

        def settled(name):
            codes, counts = zip(*held[name])
            codes, at = np.unique(np.concatenate(codes), return_inverse=True)
            held[name] = [(codes, np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64))]
            return held[name][0]

        for names, texts in unpack(batches) if unpack else (batch.columns for batch in batches):
            texts = text_array(texts)
            for i, name in enumerate(names.to_pylist()):
                if name is None:
                    continue
                held.setdefault(name, []).append(gram_counts(texts[i].as_py()))
                if len(held[name]) > 64:
                    settled(name)
        for name in held:
            codes, counts = settled(name)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    lang = F.col(lang_col)
    known = text_batches(rows).filter(lang.isNotNull()).select((lang if unpack else lang.cast("string")).alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(freeing(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= top)
    out: dict = {}
    for r in ranked.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.code)
    return Profiles(out, top)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """df with lang_pred string and score double."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    rest = [c for c in df.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([df.schema[text_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *[df.schema[c] for c in rest]])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [shared.value.classify(t.as_py()) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), *part.columns[1:]], names=names)

    return text_batches(df).select(text_col, *rest).mapInArrow(freeing(run), schema)
