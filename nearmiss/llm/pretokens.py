"""Byte-level BPE tokenizer files: vocabulary, merges, special strings and the splitting of texts into pre-tokens."""
import json

import regex

#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list:
    """The character that stands for each byte in the vocabulary: itself if visible, else the next one from code point 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """What a tokenizer file says: label (bytes) of each id, merges as id triples in order of rank, special strings and their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("only byte-level BPE without normaliser and prefix blank is built in")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take in their surroundings are not built in")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for text, i in ids.items():
            if text not in self.special:
                self.labels[i] = bytes(byte_of[c] for c in text)
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.bytes = [ids[c] for c in byte_letters()]


class Splitter:
    """Texts to pre-tokens: special strings are cut out first, the rest is split by the pattern."""

    def __init__(self, special: list):
        self.find = regex.compile(PATTERN).findall
        self.special = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if special else None

    def __call__(self, text: str) -> list:
        if not any(s in text for s in self.special):
            return self.find(text)
        out = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(part)
            else:
                out += self.find(part)
        return out
