"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a blank mark after another character, so no piece reaches over the place where a blank follows something else.
A text is cut there into chunks (blanks and what follows them; the text's own first blank is the one that the model adds), and each
distinct chunk of the corpus is segmented once:

1. Texts are cut into chunks and packed into blocks of about `block_bytes`: the block's distinct chunks in order of a hash, and for
   every place of every document the chunk that stands there. Blocks are written in buckets by their number.
2. Each block sends its distinct chunks by hash range to shards, sized by distinct chunks. A shard segments a chunk when it first meets it and
   answers every block with the ids of its chunks.
3. Blocks meet their answers and join the ids back by position; the text is decoded from those ids in the same pass.

What moves is distinct chunks per block, not per document; a chunk that every document holds costs one entry per block, and no task depends
on how often it occurs. `split_model` refuses models to which this does not apply.

Defined results: null and empty texts have no pieces (only the ids asked for in addition); every input row gives one row, so repeated and
null ids stay; an empty table gives an empty table; other columns are ignored by encode and passed through by decode, where a column of the result's
name is replaced. Very long texts are cut a million characters at a time, but the positions of one text are held together, about 4 bytes
a chunk. Ids outside the vocabulary raise IndexError; bytes that are not UTF-8 decode to one replacement character each.
"""
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.blocks import deal, gather, pack_keys, plan_shards, sort_keys, stored_by_block, unpack_keys
from nearmiss.llm.textbytes import pack, text_array, text_batches, unpack

MARK = "▁"
_CHUNKS = re.compile(" +[^ ]*").findall
_EDGE = re.compile("(?<! ) ").search
_PART = 1 << 20
_RUN_CHUNKS = 200_000


def chunks(text: str):
    """Lists of consecutive chunks of a text; joined, they are a blank and the text with marks as blanks."""
    if not text:
        return
    text = " " + text.replace(MARK, " ")
    at = 0
    while at < len(text):
        edge = _EDGE(text, at + _PART) if at + _PART < len(text) else None
        end = edge.start() if edge else len(text)
        yield _CHUNKS(text[at:end])
        at = end


def split_model(path: str):
    """(model bytes, processor) of a model whose pieces do not cross blanks and that leaves texts as they are."""
    import sentencepiece

    with open(path, "rb") as f:
        proto = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.vocab_size())):
        raise ValueError("a piece of this model reaches over a blank")
    probe = "ﬁ  A b\n c "
    if model.decode(model.encode(probe)) != probe or not model.id_to_piece(model.encode("a")[0]).startswith(MARK):
        raise ValueError("only models that add a blank and normalise nothing are built in")
    return proto, model


class Segmenter:
    """Packed ids (unsigned, 32 bits) of chunks."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.blank = array("I", [self.model.piece_to_id(MARK)]).tobytes()

    def __call__(self, new: list) -> list:
        """new: chunks as UTF-8; the model adds the first blank of each itself."""
        ids = self.model.encode([c[1:].decode() for c in new], num_threads=1)
        return [array("I", x).tobytes() if c != b" " else self.blank for c, x in zip(new, ids)]


class _Index(dict):
    def __missing__(self, chunk):
        out = self[chunk] = len(self)
        return out


_BLOCK = ["block", "ids", "words", "lengths", "n_words", "per_doc", "places"]


def chunk_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs: id, text. One row per block of documents."""
    def cut(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        index, ids, n, at, held = _Index(), [], [], [], 0

        def row(id_type):
            keys, place, _ = sort_keys([c.encode() for c in index])
            words, lengths = pack_keys(keys)
            places = place[np.concatenate([np.zeros(0, np.int64), *at])]
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([words], pa.binary()), pa.array([lengths], pa.binary()),
                                               pa.array([len(keys)], pa.int64()), pa.array([pack(np.array(n, np.int64))], pa.binary()), pa.array([pack(places)], pa.binary())], names=_BLOCK)

        for batch in batches:
            kind, texts = batch.column(0).type, text_array(batch.column(1))
            for i in range(batch.num_rows):
                text, count = texts[i].as_py(), 0
                for part in chunks(text):
                    at.append(np.fromiter(map(index.__getitem__, part), np.int64, len(part)).astype(np.uint32))
                    count += len(part)
                ids.append(batch.column(0)[i].as_py())
                n.append(count)
                held += len(text)
                if held >= block_bytes:
                    yield row(kind)
                    made, index, ids, n, at, held = made + 1, _Index(), [], [], [], 0
        if ids:
            yield row(kind)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), T.StructField("words", T.BinaryType()),
                           T.StructField("lengths", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("per_doc", T.BinaryType()), T.StructField("places", T.BinaryType())])
    return docs.mapInArrow(cut, schema)


def segment(dealt: DataFrame, shared) -> DataFrame:
    """dealt: rows of blocks.deal. One row per block and shard: block, shard, counts and pieces (packed) of the block's chunks of that shard."""
    def answer(batches):
        make, known, shard = Segmenter(shared.value), {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() != shard:
                    known, shard = {}, batch.column(1)[i].as_py()
                keys = unpack_keys(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                new = [k for k in keys if k not in known]
                known.update(zip(new, make(new)))
                found = [known[k] for k in keys]
                counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([pack(counts)], pa.binary()),
                                                  pa.array([pack(np.frombuffer(b"".join(found), np.uint32))], pa.binary())], names=["block", "shard", "counts", "pieces"])

    return dealt.mapInArrow(answer, "block long, shard int, counts binary, pieces binary")


class Decoder:
    """Ids to bytes, with arrays whose size is that of the vocabulary."""

    def __init__(self, model):
        labels = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                  else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.vocab_size())]
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(labels), np.uint8)
        self.hidden = np.array([model.is_control(i) for i in range(model.vocab_size())])
        self.marked = np.array([model.id_to_piece(i).startswith(MARK) for i in range(model.vocab_size())])
        self.byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list:
        """The text of ids[bounds[i]:bounds[i + 1]] for each i."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        raw = gather(self.flat, self.starts[ids], self.sizes[ids]).tobytes()
        shown = np.flatnonzero(~self.hidden[ids])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            j = int(np.searchsorted(shown, a))
            blank = j < len(shown) and shown[j] < b and self.marked[ids[shown[j]]]  # the blank that the model adds
            part = raw[ends[a] + blank:ends[b]]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._lossy(ids[a:b], bool(blank)))
        return out

    def _lossy(self, ids, blank):
        """As texts, where byte pieces may be no UTF-8: each byte of a run that begins no character gives one replacement character."""
        out, i = [], 0
        while i < len(ids):
            j = i
            while j < len(ids) and self.byte[ids[j]]:
                j += 1
            if j > i:
                left = bytes(int(self.flat[self.starts[x]]) for x in ids[i:j])
                while left:
                    for n in (1, 2, 3, 4):
                        try:
                            out.append(left[:n].decode())
                            break
                        except UnicodeDecodeError:
                            pass
                    else:
                        n = 1
                        out.append("�")
                    left = left[n:]
                i = j
            else:
                out.append(self.flat[self.starts[ids[i]]:self.starts[ids[i]] + self.sizes[ids[i]]].tobytes().decode())
                i += 1
        text = "".join(out)
        return text[1:] if blank else text


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True, block_bytes: int = 16 << 20, shard_keys: int = 400_000) -> DataFrame:
    """One row per document: id, ids array<int> (with the end id last, if asked for) and decoded, the text that they decode to."""
    spark = docs.sparkSession
    proto, model = split_model(model_path)
    shared, decoder, last = spark.sparkContext.broadcast(proto), spark.sparkContext.broadcast(Decoder(model)), model.eos_id()
    own = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = stored_by_block(chunk_blocks(own, block_bytes))
    answers = (segment(deal(blocks, plan_shards(blocks, shard_keys)), shared).groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("shard", "counts", "pieces"))).alias("found"))
               .select("block", F.transform("found", lambda x: x["counts"]).alias("counts"), F.transform("found", lambda x: x["pieces"]).alias("pieces")))

    def join(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, per_doc, places, counts, pieces = [batch.column(c)[i] for c in range(5)]
                doc_ids, ends = doc_ids.values, np.cumsum(unpack(per_doc.as_py()), dtype=np.int64)
                places = unpack(places.as_py())
                size = np.concatenate([np.zeros(0, np.uint32), *map(unpack, counts.as_py() or [])]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.uint32), *map(unpack, pieces.as_py() or [])]).astype(np.int32)
                start, low = np.cumsum(size) - size, 0
                while low < len(ends):
                    before = int(ends[low - 1]) if low else 0
                    high = max(low + 1, int(np.searchsorted(ends, before + _RUN_CHUNKS)))
                    at, stops = places[before:ends[high - 1]], ends[low:high] - before
                    total = np.concatenate([[0], np.cumsum(size[at])])
                    bounds = np.concatenate([[0], total[stops]])
                    ids = gather(flat, start[at], size[at])
                    texts = decoder.value.texts(ids, bounds)
                    if end_id:
                        ids = np.insert(ids, bounds[1:], last)
                        bounds = bounds + np.arange(len(bounds))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(low, high - low), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                                                      pa.array(texts, pa.string())], names=["id", "ids", "decoded"])
                    low = high

    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return blocks.select("block", "ids", "per_doc", "places").join(answers.hint("merge"), "block", "left").select("ids", "per_doc", "places", "counts", "pieces").mapInArrow(join, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text that the ids (array<int>; null: none) stand for."""
    shared = df.sparkSession.sparkContext.broadcast(Decoder(split_model(model_path)[1]))
    rest = [c for c in df.columns if c not in (ids_col, text_col)]
    schema = T.StructType([df.schema[ids_col], T.StructField(text_col, T.StringType()), *[df.schema[c] for c in rest]])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.array(batch.column(0)[i].as_py() or [], np.int64)
                if len(ids) and ids.min() < 0:
                    raise IndexError(f"id {ids.min()} is outside the vocabulary")
                text = shared.value.texts(ids, np.array([0, len(ids)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array(text, pa.string()), *[c.slice(i, 1) for c in batch.columns[1:]]], names=names)

    return df.select(ids_col, *rest).mapInArrow(run, schema)
