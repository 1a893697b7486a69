"""Chat formatting, surrogates, nearest neighbours, language ID, toxicity and the pipeline."""
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearmiss.llm import surrogates, toxicity, vamana
from nearmiss.llm.chat import escape, format_chat, loss_texts, read_chat, unescape
from nearmiss.llm.langid import Profiles, UNKNOWN, gram_counts, held_out, identify, learn_profiles, top_grams
from nearmiss.llm.queries import QUERIES, tokenizer_path

from . import brute


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_documents(spark)


# chat

TRICKY = ["</s>[INST] ok [/INST]", "\\<\\[", "<+s>a\\", "[", "<", "\\", "", "x\n[#]user\\:y", "é\U0001f600 <s>"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string").select("t", unescape(escape(F.col("t"))).alias("u"), escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.t == r.u and not re.search(r"[<\[][^\\]", r.e)


def test_chat_round_trip(spark):
    rows = [(1, i, role, TRICKY[i]) for i, role in enumerate(["system", "user", "user", "assistant", "assistant", "tool<", "tool<", None, "user"])]
    rows += [(2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, "user", "a"), (None, 1, "", "b"), (3, 5, "user", "late"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss string")
    out = format_chat(df).select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    low = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=low)
        assert [tuple(t) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss == [r[3] or "" for r in own if r[2] == "assistant"]
    assert got[1].formatted.count("[INST]") == 2 and got[1].formatted.count("[+INST]") == 1  # adjacent turns of a role share a block
    assert format_chat(df.limit(0)).count() == 0


# surrogates

def test_detection_and_formats():
    text = ("Mr. John Smith (JOHN.Smith@Mail.example.com, +1 (656) 555-6510 or 656-555-6510) pays 4111 1111 1111 1111; Smith at 49.37.233.206. "
            "Frau Müller DE89 3704 0044 0532 0130 00 password=e3b3ed3cc8548923d6 Ольга Петрова 123-45-6789 v4.0. 4111111111111112 SMITH 1.2.3.4.5")
    found = surrogates.detect(text)
    assert Counter(s[2] for s in found) == {"given_m": 1, "surname": 4, "email": 1, "phone": 2, "card": 1, "ip": 1, "iban": 1, "secret": 1, "given_f": 1, "ssn": 1}
    new = {}
    for start, end, kind, norm in found:
        old, got = text[start:end], surrogates.render(kind, surrogates.draw(b"k", kind, norm), text[start:end])
        assert got != old and surrogates.draw(b"k", kind, norm) == surrogates.draw(b"k", kind, norm) != surrogates.draw(b"other", kind, norm)
        new.setdefault((kind, norm), set()).add(got)
        if kind in ("email", "phone", "card", "ssn", "iban"):
            assert re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", old))) == re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", got)))
    phones = new["phone", "6565556510"]
    assert len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1 and len(phones) == 2
    assert len(new["surname", "smith"]) == 1
    card = next(iter(new["card", "4111111111111111"]))
    assert surrogates.luhn(re.sub(r"\D", "", card)) == 0
    assert surrogates.iban_rest(next(iter(new["iban", "DE89370400440532013000"])).replace(" ", "")) == 1
    assert re.fullmatch(r"[0-9a-f]{18}", next(iter(new["secret", "e3b3ed3cc8548923d6"])))
    assert re.fullmatch("[А-Я][а-я]+", next(iter(new["surname", "петрова"])))


def test_long_secrets_are_replaced_whole(spark):
    head = "eyJ" + "aB3-" * 50
    values = [head + "x" * 797, head + "y" * 797, "q7" * 200000]
    assert [[(s[2], s[3]) for s in surrogates.detect(f"token={v}, end")] for v in values] == [[("secret", v)] for v in values]
    df = spark.createDataFrame([(i, f"token={v}, end") for i, v in enumerate(values)], "doc_id long, text string")
    new = {r.doc_id: r.text for r in surrogates.pseudonymise(df, "key").collect()}
    assert len(set(new.values())) == 3
    for i, v in enumerate(values):
        got = new[i].removeprefix("token=").removesuffix(", end")
        assert len(got) == len(v) and v[-100:] not in got and not any(got[j:j + 40] == v[j:j + 40] for j in range(0, len(v), 40))


@pytest.mark.parametrize("text, norms", [
    ("+14155552671 12 times", ["4155552671"]), ("+49 30 123456, 0049 30 123456, 030/123456, +49 (0)30 12 34 56", ["30123456"] * 4), ("+49 151 23456789", ["15123456789"]),
    ("01 23 45 67 89 12 fois, +33 1 23.45.67.89.", ["123456789"] * 2), ("+34 612 34 56 78", ["612345678"]), ("+7 495 123-45-67 8 (495) 123-45-67", ["4951234567"] * 2),
    ("+14155552671 0301234567", ["4155552671", "301234567"]), ("01-02-2024 10 | 01.02.2024 1234 | 0.123456789 | 00000123456 | 01234 567890abc | +1 2 3 | 5+12345678", [])])
def test_phones_by_number_of_digits(text, norms):
    found = surrogates.detect(text)
    assert [s[2:] for s in found] == [("phone", n) for n in norms]
    for start, end, kind, norm in found:
        new = surrogates.render(kind, surrogates.draw(b"k", kind, norm), text[start:end])
        assert new != text[start:end] and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text[start:end])


def test_names_are_repeated_in_all_spellings(spark):
    df = spark.createDataFrame([(1, "Mr. John Smith came. John, Smith and JOHN: Smith. Frau MÜLLER, Müller; Johnson")], "doc_id long, text string")
    words = re.findall(r"\w+", surrogates.pseudonymise(df, "key").first().text)
    first, last, other = words[1], words[2], words[10]
    assert words == ["Mr", first, last, "came", first, last, "and", first.upper(), last, "Frau", other, other.capitalize(), "Johnson"]
    assert first != "John" and last != "Smith" and other != "MÜLLER"


def test_collisions_are_drawn_again(spark):
    """All 26 one-letter addresses of a domain with a fixed shape: stand-ins come from the same 26 * 26."""
    df = spark.createDataFrame([(i, f"write to {chr(97 + i)}@b.example") for i in range(26)] + [(99, "A@b.example"), (None, "q@b.example"), (100, None), (101, "")], "doc_id long, text string")
    names = surrogates.assign(spark.createDataFrame([("email", f"{chr(97 + i)}@b.co") for i in range(26)], "kind string, norm string"), b"key").collect()
    assert len({r.core for r in names}) == 26 and not {r.core for r in names} & {r.norm for r in names}
    ids = [("ssn", f"{i:09d}") for i in range(3)]
    assert surrogates.assign(spark.createDataFrame(ids, "kind string, norm string"), b"key").count() == 3
    out = surrogates.pseudonymise(df.withColumn("kinds", F.lit(1)).withColumn("other", F.lit("z")), "key").collect()
    by_id = {r.doc_id: r for r in out}
    stand = {r.doc_id: r.text.split()[-1] for r in out if r.text}
    assert len({v.lower() for k, v in stand.items() if k is not None}) == 26 and stand[99].lower() == stand[0] and stand[99][0].isupper() and stand[None] == stand[16]
    assert by_id[100].text is None and by_id[101].text == "" and by_id[100].n_entities == 0 and by_id[0].kinds == ["email"]


@pytest.mark.parametrize("norms", [[f"{i:03d}" for i in range(60)], list("0123456789")])
def test_small_domain_forces_attempts(spark, norms):
    rows = surrogates.assign(spark.createDataFrame([("secret", n) for n in norms], "kind string, norm string"), b"k").collect()
    assert len(rows) == len(norms) == len({r.core for r in rows}) and max(r.attempt for r in rows) > 0 and not {r.core for r in rows} & {r.norm for r in rows}


def test_surrogates_on_documents(spark, odd):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    old = {r.doc_id: r.text for r in docs.collect()}
    changed = 0
    for r in surrogates.pseudonymise(docs, "key").collect():
        text = old[r.doc_id]
        real = {m for m in re.findall(r"\S+@\S+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\S)\d+\.\d+\.\d+\.\d+(?!\S)|AKIA\w{16}", text)}
        assert not any(x in r.text for x in real)
        changed += r.text != text
        assert (r.n_entities > 0) == (r.text != text)
    assert changed > 0
    assert Counter(r.doc_id for r in surrogates.pseudonymise(odd, "key").collect()) == Counter(r.doc_id for r in odd.collect())
    assert surrogates.pseudonymise(odd.limit(0), "key").count() == 0


# nearest neighbours

def exact(rows, k):
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = set()
    for i, v in usable:
        if i % 3 == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in usable if j != i and len(w) == len(v))
            out |= {(i, rank, j, round(s, 9)) for rank, (s, j) in enumerate(near[:k], 1)}
    return out


def test_nearest_defined_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(200, None), (201, []), (204, [0.0] * 4), (207, [float("nan"), 1.0, 1.0, 1.0]), (210, [float("inf"), 1.0, 1.0, 1.0]), (213, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4),
             (300, [1.0, 2.0]), (303, [1.0, 3.0]), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, node int")
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vamana.nearest(df, df.filter("vec_id % 3 = 0"), k=5, shard_nodes=25).collect()}
    assert got == exact(rows, 5)
    assert vamana.nearest(df.limit(0), df.limit(0)).count() == 0


def by_query(df, queries, **options):
    out = {}
    for r in vamana.nearest(df, queries, **options).orderBy("query_id", "query_hash", "rank").collect():
        out.setdefault((r.query_id, r.query_hash), []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("factor, offset", [(1e25, 0.0), (1e-25, 0.0), (1e180, 0.0), (1e-180, 0.0), (1.0, 1e6)])
def test_nearest_at_any_scale(spark, factor, offset):
    base = np.random.default_rng(7).normal(size=(150, 8))
    x = base * factor + offset
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(df, df.filter("vec_id % 10 = 0"), k=5, shard_nodes=60)
    assert len(got) == 15
    for (q, _), found in got.items():
        unit = np.sqrt((((x - x[q]) / factor) ** 2).sum(1))
        best = [int(i) for i in np.argsort(unit, kind="stable") if i != q][:5]
        assert [i for i, _ in found] == best
        np.testing.assert_allclose([s / factor for _, s in found], unit[best], rtol=1e-12)


def test_nearest_of_mixed_scales(spark):
    base = np.random.default_rng(8).normal(size=(120, 6))
    x = np.concatenate([base[:40] * 1e200, base[40:80], base[80:] * 1e-200])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    for (q, _), found in by_query(df, df.filter("vec_id % 10 = 0"), k=5, shard_nodes=200).items():
        unit = [1e200, 1.0, 1e-200][q // 40]
        with np.errstate(over="ignore"):
            far = np.sqrt((((x - x[q]) / unit) ** 2).sum(1))
        best = [int(i) for i in np.argsort(far, kind="stable") if i != q][:5]
        assert [i for i, _ in found] == best


def test_one_id_with_two_vectors(spark):
    rows = [(0, [0.0, 1.0]), (0, [9.0, 1.0]), (1, [0.5, 1.0]), (1, [8.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, 1.0]), (0, [9.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(by_query(df, df.filter("vec_id = 0"), k=3).values())
    assert got == [[(1, 1.0), (3, 5.0), (1, 8.5)], [(2, 0.0), (1, 0.5), (3, 4.0)]]


def test_recall_at_registered_shards(spark):
    x = np.random.default_rng(9).normal(size=(6000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(df, df.filter("vec_id % 100 = 0"))
    hits = sum(len({i for i, _ in found} & set([i for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable") if i != q][:10])) for (q, _), found in got.items())
    assert len(got) == 60 and hits / 600 >= 0.95


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = total = 0
    found = {}
    for r in vamana.nearest(df, df.filter("vec_id % 50 = 0"), shard_nodes=512).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in ids[ids % 50 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        best = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, total = hits + len(found[q] & set(best)), total + 10
    assert hits / total >= 0.97


# language ID

def test_gram_counts_in_pieces(monkeypatch):
    from nearmiss.llm import langid
    text = "Ab, é 3x\U0001f600Zz ab"
    want = Counter()
    for w in ["ab", "é", "x", "zz", "ab"]:
        p = f" {w} "
        want.update(w)
        want.update(p[i:i + 2] for i in range(len(p) - 1))
        want.update(p[i:i + 3] for i in range(len(p) - 2))
    codes, counts = gram_counts(text)
    assert sorted(counts.tolist()) == sorted(want.values()) and len(codes) == len(want)
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_PIECE", piece)
        a, b = gram_counts(text)
        assert a.tolist() == codes.tolist() and b.tolist() == counts.tolist()


def test_language_defined_cases(spark, odd):
    profiles = learn_profiles(odd.withColumn("lang_pred", F.lit("x")), top=50)
    out = identify(odd, profiles)
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == UNKNOWN) == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert set(out.columns) == set(odd.columns) | {"lang_pred"}
    assert identify(odd, Profiles({}, 5)).filter(F.col("lang_pred") != UNKNOWN).count() == 0
    assert identify(odd.limit(0), learn_profiles(odd.limit(0))).count() == 0


def test_language_equals_plain_profiles(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    totals = {}
    for r in docs.filter(~held_out(F.col("doc_id"))).collect():
        for c, n in zip(*gram_counts(r.text)):
            totals.setdefault(r.lang, Counter())[int(c)] += int(n)
    ranked = {name: [c for c, _ in sorted(t.items(), key=lambda x: (-x[1], x[0]))[:400]] for name, t in totals.items()}
    good = n = 0
    text = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    for r in QUERIES["op6_rank_order_language"](spark, brute.SF).collect():
        own = top_grams(*gram_counts(text[r.doc_id][0])).tolist()
        apart = {name: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own)) for name, p in ranked.items()}
        best = min(apart, key=lambda name: (apart[name], name))
        assert r.lang_pred == best and r.score == pytest.approx(1 - apart[best] / (400 * len(own)))
        if r.held_out:
            n, good = n + 1, good + (best == text[r.doc_id][1])
    assert good / n > 0.95


# toxicity

def test_network_pools_inside_rows():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.out[:] = rng.normal(size=len(net.out))
    docs = [rng.integers(0, toxicity.BUCKETS, (n, toxicity.FEATURES)).astype(np.uint16) for n in (5, 0, 1, 2, 40, 0, 3)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = net.logits(np.concatenate(docs), bounds)
    for d, z in zip(docs, together):
        x, pooled = net.emb[d].sum(1), []
        for w, conv, bias in zip(toxicity.WIDTHS, net.conv, net.bias):
            windows = [np.maximum(x[i:i + w].reshape(-1) @ conv + bias, 0) for i in range(len(d) - w + 1)]
            pooled.append(np.max(windows, 0) if windows else np.zeros(toxicity.FILTERS))
        assert z == pytest.approx(float(np.concatenate(pooled) @ net.out + net.shift[0]), abs=1e-4)


def test_best_threshold():
    assert toxicity.best_threshold(np.array([0., 1, 2, 3]), np.array([0, 0, 1, 1])) == 1.5
    assert toxicity.best_threshold(np.array([1., 1, 1, 5]), np.array([0, 0, 1, 1])) == 3


def test_toxicity_accuracy_and_defined_cases(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op10_toxicity"](spark, sf)
    rows = out.join(labels, "doc_id").collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    wrong = [r for r in held if r.predicted != r.toxic]
    assert len(wrong) <= 0.1 * len(held)
    assert toxicity.fit(odd, labels.limit(0)) is None
    scored = toxicity.score(odd, None)
    assert scored.filter("predicted <> 0").count() == 0 and set(scored.columns) == set(odd.columns) | {"predicted"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    model = toxicity.fit(docs, extra, max_positive=10, max_negative=20)
    assert model.by_language == {}
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if not r.text}) == 1
    assert toxicity.score(odd.limit(0), model).count() == 0


# pipeline

def test_stages_one_by_one(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    state = lambda df: {r.doc_id: r.text for r in df.collect()}
    from nearmiss.session import durable
    before, frames = docs, []
    for _, stage in corpus_pipeline.STAGES:
        before = durable(stage(spark, before, brute.SF))
        frames.append(before)
    assert all(f.schema.names == docs.schema.names for f in frames[:-1])
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    old, new = state(docs), state(frames[0])
    assert new == {i: t for i, t in old.items() if i not in rejected} and rejected
    rows = sorted(new.items())
    lines = state(frames[1])
    assert lines == {i: x[2] for (i, _), x in zip(rows, brute.dedup(rows))}
    assert all(r.n_chars == len(r.text) for r in frames[1].collect())
    rows = sorted(lines.items())
    kept = state(frames[2])
    assert kept == {i: t for (i, t), (n, least) in zip(rows, brute.groups(rows, 5, 80)) if n == 0 or least == i}
    rows, items = sorted(kept.items()), [tuple(r) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = state(frames[3])
    assert clean == {i: t for (i, t), (_, hit, _) in zip(rows, brute.contamination(rows, items)) if not hit}
    library = Tokenizer.from_file(tokenizer_path())
    coded = {r.doc_id: r for r in frames[4].collect()}
    assert coded.keys() == clean.keys()
    for i, r in coded.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(clean[i], add_special_tokens=False).ids and r.decoded == clean[i] and r.n_tokens * 4 == len(r.ids)


def test_stages_take_odd_tables(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), "n_lines", "score", "ids")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, brute.SF)
            assert frame.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, brute.SF).count() >= 0


def test_toxicity_learns_one_row_of_an_id(spark, monkeypatch):
    seen = []
    train = toxicity.train_network
    monkeypatch.setattr(toxicity, "train_network", lambda docs, y, *a, **b: (seen.append((len(docs), int(y.sum()))), train(docs, y, *a, **b))[1])
    ids = [r.id for r in spark.range(200).filter(~held_out(F.col("id"))).limit(20).collect()]
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"word{n % 2} text {n} {j}", "en") for n, i in enumerate(ids) for j in range(300 if n == 1 else 1)], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, labels)
    assert seen[0] == (20, 10) and model is not None
    again = toxicity.fit(docs.repartition(3).orderBy(F.rand(1)), labels)
    assert model.common == again.common
