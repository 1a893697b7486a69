"""BPE encoding by a deterministic automaton over tokens, and decoding by its arc labels.

compile_automaton builds the automaton whose accepted token sequences are exactly the proper BPE tokenizations. It starts from one
state with a loop for each byte and adds a gadget for each merge u v -> w in order of rank: the state that u leads to loses its
arc v (a copy loses it if others share the state), and every state with an arc u gets an arc w to where v led. States and columns
are shared until a merge tells them apart, so the bit table stays far below tokens times tokens; its size is
bounded by the tokenizer file, which is broadcast.

A word is encoded from left to right along arcs, the longest label first. Where no arc leads on, the step before takes the next
label; each prefix has one proper tokenization, so a place that failed once is never tried again and the work is linear in the
word's length. Distinct words are encoded once per Python worker, up to CACHED_WORDS kept at a time.
Decoding joins the labels of the arcs.

Defined results: null text has no ids and decodes to empty text; ids outside the vocabulary raise IndexError; any other
column passes through, clashing result columns are replaced. Bytes that are not UTF-8 decode to replacement characters.
"""
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from nearmiss.llm.pretokens import Splitter, Vocabulary
from nearmiss.llm.textbytes import freeing, text_array, text_batches

CACHED_WORDS = 150_000
RUN_ROWS = 512


def compile_automaton(vocabulary: Vocabulary):
    """(state of each token, column of each token, bit table): arc t after token s is bit column[t] of row state[s]; row 0 starts."""
    n = len(vocabulary.labels)
    arcs = np.zeros((4096, 1024), np.uint8)
    state, column = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    state[vocabulary.bytes], column[vocabulary.bytes] = 0, 0
    arcs[0, 0] = 1
    row_users, column_users = [len(vocabulary.bytes) + 1], [len(vocabulary.bytes)]
    for u, v, w in vocabulary.merges:
        q, r = state[u], state[v]
        if q < 0 or r < 0 or not arcs[q, column[v] >> 3] >> (column[v] & 7) & 1:
            continue
        if row_users[q] > 1 or u == v:
            new = len(row_users)
            if new == len(arcs):
                arcs = np.concatenate([arcs, np.zeros_like(arcs)])
            arcs[new] = arcs[q]
            row_users[q] -= 1
            row_users.append(1)
            state[u] = new
        if column_users[column[v]] > 1:
            old, new = int(column[v]), len(column_users)
            if new == 8 * arcs.shape[1]:
                arcs = np.concatenate([arcs, np.zeros_like(arcs)], axis=1)
            filled = len(row_users)
            arcs[:filled, new >> 3] |= (arcs[:filled, old >> 3] >> np.uint8(old & 7) & np.uint8(1)) << np.uint8(new & 7)
            column_users[old] -= 1
            column_users.append(1)
            column[v] = new
        arcs[state[u], column[v] >> 3] &= np.uint8(255 ^ (1 << int(column[v] & 7)))
        state[w], column[w] = r, column[u]
        row_users[r] += 1
        column_users[column[u]] += 1
    return state, column, np.ascontiguousarray(arcs[:len(row_users), :(len(column_users) + 7) // 8])


class Encoder:
    """Words to packed ids (little-endian, 32 bits each) by table-driven transitions."""

    def __init__(self, vocabulary: Vocabulary):
        state, column, arcs = compile_automaton(vocabulary)
        self.special, self.width, self.arcs = vocabulary.special, arcs.shape[1], arcs.tobytes()
        self.rows = (state * self.width).tolist()
        self.columns = column.tolist()
        special = set(self.special.values())
        self.ids = {label: i for i, label in enumerate(vocabulary.labels) if state[i] >= 0 and i not in special}
        self.reach = {}  # longest token by its first three bytes
        for label in self.ids:
            if len(label) > 2:
                self.reach[label[:3]] = max(self.reach.get(label[:3], 2), len(label))

    def tokens(self, word: bytes) -> list:
        """The proper tokenization of one word."""
        ids, reach, rows, columns, arcs = self.ids.get, self.reach.get, self.rows, self.columns, self.arcs
        n, at, row, path, dead = len(word), 0, 0, [], None
        length = min(n, reach(word[:3], 2))
        while at < n:
            while length:
                t = ids(word[at:at + length])
                if t is not None:
                    c = columns[t]
                    if arcs[row + (c >> 3)] >> (c & 7) & 1 and not (dead and at + length in dead):
                        break
                length -= 1
            if length:
                path.append((t, at, row, length))
                at, row = at + length, rows[t]
                length = min(n - at, reach(word[at:at + 3], 2))
            else:  # no arc leads on from here, and the path to this place is the only one
                dead = dead or set()
                dead.add(at)
                _, at, row, length = path.pop()
                length -= 1
        return [step[0] for step in path]

    def packed(self, word: str) -> bytes:
        if word in self.special:
            return _packed([self.special[word]])
        return _packed(self.tokens(word.encode()))


def _packed(ids: list) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """Packed ids of the words met so far; when full, words that are met for the first time are not kept any more."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word):
        out = self.encoder.packed(word)
        if len(self) < CACHED_WORDS:
            self[word] = out
        return out


_KEPT: dict = {}


def _splitter_and_words(key: str, special: list, encoder):
    """The worker's splitter and words for one call of encode; they outlive the task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Splitter(special), _Words(encoder())
    return _KEPT[key]


def _with_column(df: DataFrame, source: str, made: list, make):
    """df with the columns made, (name, type), from source by make(arrow array) for runs of rows."""
    rest = [c for c in df.columns if c != source and c not in dict(made)]
    schema = T.StructType([df.schema[source], *[T.StructField(*m) for m in made], *[df.schema[c] for c in rest]])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, RUN_ROWS):
                part = batch.slice(i, RUN_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(part.column(0)), *part.columns[1:]], names=names)

    return text_batches(df).select(source, *rest).mapInArrow(freeing(run), schema)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids binary: the token ids of each whole text, little-endian unsigned 32-bit integers."""
    vocabulary = Vocabulary(tokenizer)
    shared = df.sparkSession.sparkContext.broadcast(Encoder(vocabulary))
    special = list(vocabulary.special)
    key = uuid.uuid4().hex

    def make(texts):
        split, words = _splitter_and_words(key, special, lambda: shared.value)
        word = words.__getitem__
        return [pa.array([b"".join(map(word, split(t))) for t in text_array(texts).to_pylist()], pa.binary())]

    return _with_column(df, text_col, [(ids_col, T.BinaryType())], make)


class Labels:
    """Packed ids to text by arc labels."""

    def __init__(self, labels: list):
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.flat, self.starts = np.frombuffer(b"".join(labels), np.uint8), np.cumsum(self.sizes) - self.sizes

    def text(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        n = self.sizes[ids]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return ""
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text that the packed ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(Labels(Vocabulary(tokenizer).labels))
    return _with_column(df, ids_col, [(text_col, T.StringType())], lambda packed: [pa.array([shared.value.text(x or b"") for x in packed.to_pylist()], pa.string())])


def encode_decode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with ids binary, as encode, and the text that decode makes of them, in one pass of one worker a core."""
    vocabulary = Vocabulary(tokenizer)
    shared = df.sparkSession.sparkContext.broadcast((Encoder(vocabulary), Labels(vocabulary.labels)))
    special, key = list(vocabulary.special), uuid.uuid4().hex

    def make(texts):
        split, words = _splitter_and_words(key, special, lambda: shared.value[0])
        packed = [b"".join(map(words.__getitem__, split(t))) for t in text_array(texts).to_pylist()]
        return [pa.array(packed, pa.binary()), pa.array(map(shared.value[1].text, packed), pa.string())]

    return _with_column(df, text_col, [(ids_col, T.BinaryType()), (decoded_col, T.StringType())], make)
