"""Registered queries of the operators over whole tables, and their DuckDB counterparts where SQL can express them."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearmiss.llm.bpe import encode_decode
from nearmiss.llm.chat import format_chat, loss_texts, read_chat
from nearmiss.llm.crosstok import align
from nearmiss.llm.decontaminate import find_contamination
from nearmiss.llm.jaccard import jaccard_groups
from nearmiss.llm.langid import held_out, identify, learn_profiles
from nearmiss.llm.linededup import dedup_lines
from nearmiss.llm.pieces import encode as encode_pieces
from nearmiss.llm.surrogates import pseudonymise
from nearmiss.llm.tokencount import token_counts
from nearmiss.llm.toxicity import fit, score
from nearmiss.llm.trie import number_turns, prefix_trie, regraft
from nearmiss.llm.vamana import nearest
from nearmiss.session import durable

QUERIES: dict = {}
SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_decontamination(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents").select("text", "doc_id"), table(spark, sf_dir, "benchmark")
    n_hit = F.size("hit_words").cast("long")
    return find_contamination(docs, bench).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                                                  F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op5_decontamination"] = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
        FROM (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.k, g.i, win.item FROM grams g JOIN win USING (k, gram)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op7_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    turn = lambda i, role: F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text"))
    rows = rows.unionByName(spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant")))))
    chats = format_chat(rows).select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("loss"))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = r"(length({0}) + length(regexp_replace({0}, '[^<\[\\]', '', 'g')))"

SQL["op7_chat_formatting"] = rf"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role AS opens, lead(role) OVER o IS DISTINCT FROM role AS closes,
             CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 3 + {_ESCAPED.format('role')} + 2 END AS mark,
             CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 4 END AS finish
      FROM raw WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_ESCAPED.format('text')} + mark + CASE WHEN NOT opens AND role IN ('system', 'user', 'assistant') THEN 1 WHEN NOT opens THEN 1 ELSE 0 END
                + CASE WHEN closes THEN finish ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op8_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op8_line_dedup"] = rf"""
WITH lines AS (SELECT doc_id, i, line, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k
               FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT lines.*, often.owner IS NOT NULL AND often.owner <> doc_id AS gone FROM lines LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_model_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_bpe_automaton(spark, sf_dir):
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_token_counts(spark, sf_dir):
    return (token_counts(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")
            .withColumn("over_limit", F.col("n_tokens") > 512))


@query
def op3_jaccard_join(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85).withColumnRenamed("id", "doc_id")


@query
def op6_rank_order_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    out = identify(docs.select("text", "doc_id"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("text", "doc_id"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op2_robust_pruned_graph(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op1_pii_surrogates(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="nearmiss corpus key")


@query
def op13_sentencepiece(spark, sf_dir):
    out = encode_pieces(table(spark, sf_dir, "documents"), piece_model_path())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_prefix_trie(spark, sf_dir):
    convs, turns = regraft(durable(number_turns(table(spark, sf_dir, "conversations"))))
    return prefix_trie(convs, turns).drop("a", "b")


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda p, q: list_reduce(list_concat([xor(p, q)], list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
                             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

SQL["op12_prefix_trie"] = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
             FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format('conv_id')} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)),
taken AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
turns AS (SELECT t.conv_id, o.pos, o.role, o.text FROM taken t JOIN own o ON o.conv_id = t.base AND o.pos <= t.h
          UNION ALL SELECT t.conv_id, o.pos - t.h + t.taken, o.role, o.text FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.pos > t.h),
paths AS (SELECT conv_id, pos AS depth, strlen(text) AS bytes, count(*) OVER (PARTITION BY conv_id) AS n,
                 sha256(string_agg(concat(length(role), ' ', length(text), ' ', role, text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS k FROM turns
          UNION ALL SELECT c.conv_id, 0, 0, (SELECT count(*) FROM turns t WHERE t.conv_id = c.conv_id), '' FROM convs c),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS value FROM paths GROUP BY depth, k),
up AS (SELECT n.*, p.k AS up FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
known AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (depth, k)),
below AS (SELECT DISTINCT t.depth AS depth, t.k AS k, l.depth AS low_depth, l.k AS low FROM paths t JOIN paths l ON l.conv_id = t.conv_id AND l.depth >= t.depth),
sums AS (SELECT b.depth, b.k, sum(n.value) AS saved, count(*) FILTER (n.n_children = 0) AS leaves FROM below b JOIN known n ON n.depth = b.low_depth AND n.k = b.low GROUP BY 1, 2),
ends AS (SELECT depth, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM paths WHERE depth = n GROUP BY 1, 2)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM known x JOIN sums USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN nodes p ON p.depth = x.depth - 1 AND p.k = x.up
"""


@query
def op11_cross_tokenizer(spark, sf_dir):
    out = align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())
    return out.select(F.col("id").alias("doc_id"), *out.columns[1:-1], F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
