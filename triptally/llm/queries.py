"""The operators over the given tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triptally.llm import (
    bpe,
    chat_format,
    compression,
    cover_tree,
    decontaminate,
    fill_middle,
    language_id,
    ngram_join,
    packing,
    phrases,
    pii,
    suffix_dedup,
    token_counts,
    toxicity,
)
from triptally.llm.shipping import ship
from triptally.llm.tables import table

PSEUDONYM_KEY = "registered query"  # a real run has a secret one

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, folder)

        QUERIES[key] = run
        return build

    return register


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learnt = labels.where(~compression.held_out(F.col("doc_id")))
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), learnt)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    held = compression.held_out(F.col("doc_id"))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit_languages(language_id.learn_from(docs))
    told = language_id.identify(docs.select("doc_id", "text"), model)
    held = compression.held_out(F.col("doc_id"))
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.similar_documents(table(spark, folder, "documents"))
    return found.withColumnRenamed("component", "component_id")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = suffix_dedup.remove_repeats(docs)
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_chat_format")
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    return chat_format.chat_digests(chat_format.format_chats(turns.unionByName(more)))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.read_vocabulary())
    return counted.select("doc_id", "n_tokens")


@query("op5_top_k")
def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return cover_tree.top_k(vectors.where("vec_id % 50 = 0"), vectors)


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op9_pii")
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key=PSEUDONYM_KEY, count="n_replaced")


@query("op11_bpe")
def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, packed=True).drop("text")
    told = bpe.decode(coded, into="decoded")
    return told.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_collocations")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return phrases.collocations(docs).drop("example_doc", "example_place")


@query("op13_fill_middle")
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = fill_middle.fill_in_middle(docs).drop("text")
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


ORACLES["op5_top_k"] = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op3_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, ['user', 'assistant'][n + 1], '\### Assistant: </turn> ok' FROM range(2) r(n)
), sized AS (
  SELECT *, len(list_filter(range(1, length(text) + 1), lambda i:
           substr(text, i, 1) = '\' OR substr(text, i, 3) = '###' OR substr(text, i, 7) = '</turn>'
         )) AS escapes,
         len(list_filter(range(1, length(role) + 1), lambda i:
           substr(role, i, 1) IN ('\', ':') OR substr(role, i, 3) = '###'
           OR substr(role, i, 7) = '</turn>')) AS role_escapes
  FROM turns
), said AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text)
                  FILTER (WHERE role = 'assistant'), '') AS learnt,
         CAST(sum(length(role) + role_escapes + length(text) + escapes + 14) AS BIGINT) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(learnt) AS loss_chars,
       sha256(learnt) AS loss_sha256, chars AS formatted_chars
FROM said
"""

ORACLES["op7_ngram_join"] = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])
    WHEN len(w) > 0 THEN [w] ELSE [] END) AS s
  FROM cut
), sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
one AS (SELECT doc_id, unnest(s) AS g FROM shingled),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id
FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counted AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM worded, range(1, 6) s(m), unnest(range(1, len(w) - m + 2)) p(i)
  GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), frequent AS (SELECT * FROM counted WHERE f >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS w, c.m
  FROM frequent c, unnest(range(1, c.m)) u(k) WHERE c.m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k,
         CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), within AS (
  SELECT q.lang, array_to_string(string_split(q.phrase, ' ')[i:i + len - 1], ' ') AS phrase,
         max(q.f) AS most
  FROM frequent q, unnest(range(2, q.m)) u(len), unnest(range(1, q.m - len + 2)) v(i)
  WHERE q.m > 2 GROUP BY ALL
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN within i ON i.lang = l.lang AND i.phrase = l.phrase
  WHERE i.most IS NULL OR 100 * i.most < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES["op13_fill_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''),
           '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         list_transform(range(4), lambda i: CAST('0x' || substr(
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * i + 1, 8) AS BIGINT)) AS h
  FROM documents
), formed AS (
  SELECT *, len(t) AS n, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS x,
         greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS y,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>')
                   OR contains(body, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, array_to_string(t[1:x], '') AS p, array_to_string(t[x + 1:y], '') AS m,
         array_to_string(t[y + 1:], '') AS s
  FROM formed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body
                        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM cut
"""
