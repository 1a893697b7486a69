"""Plain-Python versions of the text operators, for comparison."""
import re
from collections import defaultdict

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped string, score string, ids string, id string, node string, token string"
EXTRA = ("x", "y", "z", "i", "j", "k", "t")


def odd_documents(spark):
    """Documents with nulls, empty and long texts, repeated rows, shared lines and columns whose names clash with results."""
    line = "this line is shared by many documents and is long enough"
    para = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, f"  {line.upper()}\t\nown", "en", "a"), (None, None, None, None),
            (3, para, "en", "a"), (3, para, "en", "a"), (4, para + " tail", None, "b"), (5, "one two", "en", "b"), (6, "One Two", "en", "b"), (7, "!!! ... ###", "en", "b"),
            (8, "é" * 30000 + " " + "long " * 20000, "fr", "b"), (9, "a\r\n\n\nb <|endoftext|> c\x00d   \U0001f600 ９９", "en", "c")]
    rows += [(10 + i, f"start {i}\n{line}\n{line} \nend {i}", "en", "c") for i in range(6)]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows], DOCS)


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text, SOLID)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k, percent):
    """(id, text) rows to (n_shingles, least id of the group) per row; rows with the same set are linked."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)].append(name)
    return [(len(s), min(least[find(i)], default=None)) for i, s in enumerate(sets)]


def line_key(line):
    return line.strip(BLANK).translate(LOWER)


def dedup(rows, min_chars=40, min_docs=5):
    """(id, text) rows to (n_lines, n_dropped, kept text)."""
    lowest = -(1 << 63)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(lowest if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < min_chars or len(holders[line_key(x)]) < min_docs or max(holders[line_key(x)]) == (lowest if i is None else i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(rows, items, n=10):
    """(id, text) rows and (item, text) rows to (n_words, hit positions, items)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows[tuple(w[i:i + k])].add("null" if item is None else str(item))
    lengths = {len(x) for x in windows}
    out = []
    for _, text in rows:
        w, hit, named = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i:i + k]))):
                    hit |= set(range(i, i + k))
                    named |= got
        out.append((len(w), sorted(hit), sorted(named)))
    return out
